"""Queries that SQL can't say, over their whole tables, against plain Python."""

import re

import pyarrow.parquet as pq

from assayer import lexicon
from assayer.functions import privacy as P
from assayer.plans import queries

SF = "/root/testdata/sf0.01"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>\"')\]]+|\b(?:linkedin\.com|github\.com|gitlab\.com|behance\.net|dribbble\.com|medium\.com)/[^\s<>\"')\]]+"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,5}[\s.-])\d{2,4}[\s.-]?\d{2,6}(?![\w.])"
PLACE = r"\b[A-Z][a-z]{2,}(?:[ ][A-Z][a-z]{2,})?,[ ]*[A-Z][a-z]{2,}(?:[ ][A-Z][a-z]{2,})?\b"


def documents():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def pattern(p):
    """A pattern with word edges that know all letters, and word characters that are ASCII."""
    return re.compile(p.replace(r"\b", r"(?:(?<=[^\W_])(?![^\W_])|(?<![^\W_])(?=[^\W_]))").replace(r"[\w", "[A-Za-z0-9_"))


def test_personal_data_is_redacted_everywhere(spark):
    got = {r["doc_id"]: r["text"] for r in queries.redact_personal(spark, SF).collect()}
    for d in documents():
        text = d["text"]
        for p, mark in ((P.EMAIL, "[EMAIL]"), (P.URL, "[URL]"), (P.BIRTH, "[DOB]"), (P.PHONE, "[PHONE]")):
            text = pattern(p).sub(mark, text)
        assert got[d["doc_id"]] == text
    assert sum(t != d["text"] for d, t in ((d, got[d["doc_id"]]) for d in documents())) > 20


def contact(text):
    lines = text.split("\n")
    head = "\n".join(lines[:10])
    common = lambda s: any(re.sub(r"^[.,]+|[.,]+$", "", w.lower()) in lexicon.NOT_A_NAME for w in re.split(r"[ \t\n\x0b\f\r]+", s))
    named = [s for s in (x.strip(" ") for x in lines[:8]) if 3 < len(s) <= 50 and not re.search(r"[0-9@|]", s) and not common(s) and re.search(r"^[A-Z][a-zA-Z.'’-]+(?:\s+[A-Z][a-zA-Z.'’-]+){0,3}$", s)]
    mail, phone = pattern(P.EMAIL).search(text), pattern(PHONE).search(head)
    phone = phone[0].strip(" ") if phone else ""
    places = [p for p in pattern(PLACE).findall("\n".join(lines[:8])) if not any(w.lower() in lexicon.NOT_A_NAME for w in re.split(r"\s+", p.replace(",", " ")))]
    links = list(dict.fromkeys(re.sub("[.,;)]+$", "", u) for u in pattern(URL).findall(head)))
    name, mail, phone = named[0] if named else None, mail[0] if mail else None, phone if 10 <= len(re.sub("[^0-9]", "", phone)) <= 15 else None
    return name, mail, phone, places[0] if places else None, links, (bool(name) + bool(mail) + bool(phone) + bool(links)) / 4


def test_contacts_of_all_documents(spark):
    got = {r["doc_id"]: (r["name"], r["email"], r["phone"], r["location"], r["links"], r["completeness"]) for r in queries.contact_details(spark, SF).collect()}
    want = {d["doc_id"]: contact(d["text"]) for d in documents()}
    assert [(i, got[i], want[i]) for i in want if got[i] != want[i]] == []
    assert sum(w[5] > 0 for w in want.values()) > 20
