"""A pack: the replaceable description of a business domain - fields, templates, vocabularies, priorities, weights, settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"  # string, person_name, vocab, phone, date, number, shift_cell, email
    synonyms: tuple[str, ...] = ()
    pattern: str | None = None  # values match in full, upper-cased
    vocab: str | None = None
    most: float | None = None  # numbers: usual greatest size


@dataclass(frozen=True)
class Template:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    one_of: tuple[tuple[str, ...], ...] = ()
    at_least: tuple[tuple[str, str], ...] = ()  # (later, earlier) date fields

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.required, *(f for g in self.one_of for f in g), *self.optional]))


@dataclass(frozen=True)
class Pack:
    fields: dict[str, Field]
    templates: tuple[Template, ...]
    vocab: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)
    nicknames: tuple[tuple[str, str], ...] = ()
    priorities: dict[str, tuple[str, ...]] = field(default_factory=dict)
    blocking: tuple[tuple[str, ...], ...] = (("credential_number",), ("soundex", "facility"), ("family3", "initial"))
    role_scope: tuple[tuple[str, str], ...] = ()
    job_codes: dict[str, int] = field(default_factory=dict)

    def aliases(self, vocab: str) -> list[tuple[str, str]]:
        """(alias, code), each code an alias of itself."""
        return [(a, code) for code, names in self.vocab.get(vocab, {}).items() for a in (code, *names)]


def load_pack(path: str | Path) -> Pack:
    """A pack from pack.json (or pack.yaml where a YAML reader is installed)."""
    folder = Path(path)
    if (folder / "pack.json").exists():
        raw = json.loads((folder / "pack.json").read_text())
    else:
        import yaml

        raw = yaml.safe_load((folder / "pack.yaml").read_text())
    tuples = lambda x: tuple(tuples(y) for y in x) if isinstance(x, list) else x
    return Pack(
        fields={k: Field(k, **{a: tuples(b) for a, b in v.items()}) for k, v in raw["fields"].items()},
        templates=tuple(Template(name=k, **{a: tuples(b) for a, b in v.items()}) for k, v in raw["templates"].items()),
        vocab={k: {c: tuple(a) for c, a in v.items()} for k, v in raw.get("vocab", {}).items()},
        nicknames=tuples(raw.get("nicknames", [])), priorities={k: tuple(v) for k, v in raw.get("priorities", {}).items()},
        role_scope=tuples(raw.get("role_scope", [])), job_codes=raw.get("job_codes", {}), **({"blocking": tuples(raw["blocking"])} if "blocking" in raw else {}),
    )


F_ = Field
#: Staff of care facilities: rosters, payroll, licences, schedules.
STAFFING = Pack(
    fields={f.name: f for f in [
        F_("person.employee_id", synonyms=("employee id", "emp id", "emp no", "employee number"), pattern=r"[A-Z]{0,3}\d{2,8}"),
        F_("person.given_name", "name_part", ("first name", "given name", "first")), F_("person.family_name", "name_part", ("last name", "family name", "surname", "last")),
        F_("person.full_name", "person_name", ("employee name", "name", "staff", "name on license", "full name", "employee")),
        F_("person.role", "vocab", ("job title", "role", "job code", "position", "title", "class"), vocab="roles"),
        F_("person.facility", "vocab", ("facility", "facility code", "site", "location", "building"), vocab="facilities"),
        F_("person.phone", "phone", ("phone", "mobile", "telephone", "cell")), F_("person.hire_date", "date", ("hire date", "date of hire", "start date")),
        F_("credential.number", synonyms=("license number", "license no", "lic number", "certificate number"), pattern=r"[A-Z]{1,5}[\W_]*\d{3,10}"),
        F_("credential.type", "vocab", ("license type", "credential type", "type"), vocab="roles"),
        F_("credential.expires_on", "date", ("license expiration", "expiration date", "expires", "exp date", "expiry")), F_("credential.last_verified", "date", ("last verified", "verified on")),
        F_("org.name", synonyms=("organization name", "organisation name", "vendor name", "agency name")), F_("credential.doc_type", synonyms=("document type", "doc type", "document")),
        F_("pay.payroll_id", synonyms=("payroll id", "pay id", "check number", "ref")), F_("pay.period_start", "date", ("period start", "week begin", "from", "pay period start")),
        F_("pay.period_end", "date", ("period end", "week end", "to", "pay period end")), F_("pay.hours_paid", "number", ("hours paid", "hours", "hrs", "paid hours"), most=200.0),
    ]},
    templates=(
        Template("hr_roster", ("person.employee_id", "person.role"), ("person.facility", "person.phone", "credential.number", "credential.expires_on", "person.hire_date"), (("person.given_name", "person.family_name"), ("person.full_name",))),
        Template("payroll", ("person.full_name", "pay.period_start", "pay.period_end", "pay.hours_paid"), ("pay.payroll_id", "person.role", "person.facility"), at_least=(("pay.period_end", "pay.period_start"),)),
        Template("license", ("credential.number", "person.full_name", "credential.expires_on"), ("credential.type", "credential.last_verified")),
        Template("organisation", ("org.name", "credential.doc_type", "credential.expires_on"), ("credential.number", "credential.last_verified")),
    ),
    vocab={"roles": {"RN": ("r.n.", "registered nurse"), "LPN": ("l.p.n.", "lvn", "licensed practical nurse"), "CNA": ("c.n.a.", "nurse aide", "certified nursing assistant")},
           "facilities": {"FAC-BAY": ("bayside", "bayside care center", "bys", "bay"), "FAC-RVD": ("riverdale", "riverdale care center", "rvd")}},
    nicknames=(("marc", "marcus"), ("bob", "robert"), ("bill", "william"), ("liz", "elizabeth"), ("kate", "katherine"), ("mike", "michael"), ("tony", "anthony")),
    priorities={"credential.expires_on": ("license", "hr_roster"), "person.role": ("hr_roster", "payroll")},
    role_scope=(("RN", "RN"), ("LPN", "LPN"), ("LPN", "RN"), ("CNA", "CNA")), job_codes={"RN": 7, "LPN": 9, "CNA": 10},
)
