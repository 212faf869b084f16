import math
import unicodedata
from collections import Counter

import pytest

from tallyforge.llm import language_id as li
from tallyforge.llm import queries

TEXTS = {"en": "the cat and the dog were in the house with them", "de": "der hund und die katze sind nicht im haus gewesen", "fr": "le chien et les chats étaient dans la maison avec elle"}


def labelled(make_docs):
    rows = []
    for lang, text in TEXTS.items():
        w = text.split()
        rows += [(hash(lang) % 1000 * 100 + i, " ".join(w[i % 5 :] + w[: i % 7]), lang) for i in range(30)]
    return make_docs([*rows, (1, None, "en"), (2, "123", "en"), (3, "no language given", None)])


def test_nearest_centroid(make_docs):
    model = li.fit(labelled(make_docs), per_language=20, centroids=3, dims=4096, margin=0.2)
    assert model.languages == ["de", "en", "fr"] and len(model.centroids) <= 9
    got = li.predict(make_docs([(1, "THE DOG in the HOUSE!!", "xx"), (2, "die katzen und der hund", None), (3, "les maisons étaient", "en"), (3, "les maisons étaient", "en"), (4, None), (5, ""), (6, "123 $%"), (7, "漢字漢字漢字 漢字"), (8, "the dog " * 200_000)]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} | {7: None} == {1: "en", 2: "de", 3: "fr", 4: "und", 5: "und", 6: "und", 7: None, 8: "en"}
    assert {r["doc_id"] for r in got if r["rejected"]} == {4, 5, 6, 7}
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 9


def test_letters(make_docs):
    model = li.fit(labelled(make_docs), per_language=20)
    texts = ["½ ²", "①②", "Ⅷ", "٣٤", "_", "ª", "漢", "x½"]
    got = {r["doc_id"]: r["lang_pred"] == "und" for r in li.predict(make_docs(list(enumerate(texts))), model).collect()}
    assert [got[i] for i in range(8)] == [not any(unicodedata.category(c).startswith("L") for c in t) for t in texts]


def naive_terms(text, dims):
    """Counts of a text's n-grams of 1 to 4 bytes, by the definition."""
    odd, mask = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), (1 << 32) - 1
    raw = (text or "").lower().encode()
    y, inside = [32], False
    for b in raw:
        run = 97 <= b <= 122 or b >= 128
        if run or inside:
            y.append(b if run else 32)
        inside = run
    counts = Counter()
    for k in range(4):
        for i in range(len(y) - k):
            if k == 0 and y[i] == 32:
                continue
            h = sum((y[i + j] + 1) * odd[j] for j in range(k + 1)) & mask
            z = (h ^ (h >> 15) if k else h) * (0x2C1B3C6D + 2 * k) & mask
            counts[z >> (32 - dims.bit_length() + 1)] += 1
    return counts


def test_against_the_definition(make_docs):
    docs = labelled(make_docs)
    model = li.fit(docs, per_language=1000, dims=1024, centroids=2)
    rows = [r for r in docs.collect() if r["lang"] and r["text"] and any(c.isalpha() for c in r["text"])]
    found = [naive_terms(r["text"], 1024) for r in rows]
    for term in range(1024):
        n = sum(term in c for c in found)
        assert model.idf[term] == pytest.approx(math.log((1 + len(rows)) / (1 + n)) + 1, rel=1e-5)
    texts = ["The dog, THE house", "die katze nicht", "les chats élégants", "zzz qqq", "a", "dog\tdog-dog 7 dog"]
    got = {r["doc_id"]: r for r in li.predict(make_docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        v = {k: math.log(1 + n) * float(model.idf[k]) for k, n in naive_terms(t, 1024).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.centroids]
        top = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[i]["lang_pred"] == model.languages[model.owner[top]] and got[i]["score"] == pytest.approx(cosines[top], rel=1e-4)


def test_many_languages(make_docs):
    word = lambda k: chr(97 + k // 8) * 3 + chr(105 + k % 8) * 2
    docs = make_docs([(i, f"{word(i % 60)} {word(i % 60)}s", f"l{i % 60:02d}") for i in range(240)])
    model = li.fit(docs, per_language=4, most_rows=100)
    assert len(model.languages) == 60
    got = li.predict(docs, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.9 * len(got)


def test_no_rows(make_docs):
    none = make_docs([])
    model = li.fit(none)
    assert {r["lang_pred"] for r in li.predict(make_docs([(1, "text")]), model).collect()} == {"und"}
    assert li.predict(none, model).count() == 0


def test_odd(odd_docs, make_docs):
    got = li.predict(odd_docs, li.fit(labelled(make_docs), dims=1024))
    assert got.columns == [*odd_docs.columns, "lang_pred", "score", "rejected"]
    assert got.count() == odd_docs.count()


def test_query_held_out(spark, sf_dir):
    import zlib

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.97 * len(held)
    assert not any(r["rejected"] for r in got if r["lang_pred"] != "und")
