"""Unlearned languages and random letters are rejected, and few texts of the learned ones."""

import base64
import random
import string

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import language_id as li

OTHER = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs.filter(~li.is_held_out()))


def test_what_was_not_learned_is_rejected(model):
    rng = random.Random(4)
    letters = [" ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 9))) for _ in range(n)) for n in (50, 200, 1000)]
    texts = [*OTHER.values(), *letters, base64.b64encode(rng.randbytes(3000)).decode()]
    assert li.classify(pa.array(texts), np.ones(len(texts), bool), model)[2].tolist() == [True] * len(texts)


def test_held_out_texts_are_kept(docs, model):
    texts = [r["text"] for r in docs.filter(li.is_held_out()).select("text").collect()]
    lang, score, rejected = li.classify(pa.array(texts), np.ones(len(texts), bool), model)
    known = [r for name, r in zip(lang, rejected, strict=True) if name != li.UNKNOWN]
    print(sum(known), len(known))
    assert sum(known) <= 0.01 * len(known)
