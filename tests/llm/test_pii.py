"""Personal data: base spans against the plain patterns, added ones on planted forms, odd and long texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import pii, queries
from llm_brute import SF, rows

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string, id string, row int, kind string, base string, match string, p double"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "k", "b", "m", 0.5) for i, t in enumerate(texts)], SCHEMA)


def found(df):
    return {r["id"]: [(s["start"], s["kind_no"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.find(df).collect()}


def card(rng, n=16):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "é@é.é a@b.c", "a@b.c_x@d.e@f.g..h@i.j", "x@y", "@a.b", "1.2.3.4.5.6.7.8", "0000255.1.1.256 256.1.1.1 001.02.3.4", "+1 (234) 567-8901 +12345678901234567 +1+2345678901", "日本 +49 30 1234-5678 x", "4111 1111 1111 1111-4111111111111111", "4111111111111111 " * 3]
    texts += ["".join(rng.choice("a1.@+- 0é(9)") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    texts += [f"{rng.choice(['', 'x', '-'])}{card(rng, rng.choice([14, 16, 19]))}{rng.choice(['', ' 1', '-'])}" for _ in range(50)]
    assert found(frame(spark, texts)) == {i: base(t) for i, t in enumerate(texts)}
    assert pii.find(frame(spark, [])).collect() == []
    same = frame(spark, ["a@b.c", "a@b.c"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r["id"], len(r["spans"])) for r in pii.find(same).collect()] == [(None, 1), (None, 1)]


def test_long_texts_take_linear_time(spark):
    long = ["1" * 200_000, "a" * 200_000, "1 " * 100_000, "a at b. " * 20_000, "1." * 100_000, "+1" * 100_000, "(" * 100_000, "a@" * 100_000, "4111111111111111, " * 5_000]
    got = found(frame(spark, long))
    assert [len(got[i]) for i in range(len(long))] == [0, 0, 0, 0, 25_000, 0, 0, 0, 5_000]
    assert got[8] == [(18 * k, 2, 18 * k + 16) for k in range(5_000)]


@pytest.fixture(scope="module")
def mixed(spark):
    """Texts with personal data in base forms, texts with it in other forms, and clean texts with numbers."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts, hidden = [], {}
    for _ in range(500):
        ip, mail = ".".join(str(rng.randrange(1, 255)) for _ in range(4)), f"{word()}.{rng.randrange(99)}@{word()}.example.com"
        texts.append(f"{say(9)} {rng.choice([ip, mail, card(rng), phone()])} {say(9)}")
        texts.append(f"{say(5)} {rng.randrange(10**15, 10**16)} {say(4)} at {word()}. {word().title()} {say(3)} v{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(300, 999)} {say(2)} \"{rng.getrandbits(160):040x}\" {say(3)}")
    for _ in range(40):
        forms = [f"{word()}.{rng.randrange(99)} (at) {word()}.example.com", "[.]".join(str(rng.randrange(1, 255)) for _ in range(4)), re.sub(r"(\d{4})(?=\d)", r"\1/", card(rng)), phone().replace("+", "00")]
        for form in forms:
            before = say(6)
            hidden[len(texts)] = (len(before) + 1, len(before) + 1 + len(form))
            texts.append(f"{before} {form} {say(6)}")
    return texts, hidden, {r["id"]: r["spans"] for r in pii.find(frame(spark, texts)).collect()}


def test_other_forms_are_added_and_clean_numbers_left(mixed):
    texts, hidden, got = mixed
    added = {i: [(s["start"], s["end"]) for s in spans if not s["base"]] for i, spans in got.items()}
    covered = sum(any(a <= s and e <= b for a, b in added[i]) for i, (s, e) in hidden.items())
    assert covered >= 0.8 * len(hidden)
    clean = [i for i in range(1, 1000, 2) if not base(texts[i])]
    assert len(clean) > 400 and sum(bool(added[i]) for i in clean) <= 0.02 * len(clean)
    for i, spans in got.items():
        assert [(s["start"], s["kind_no"], s["end"]) for s in spans if s["base"]] == base(texts[i])
        mine, fixed = added[i], base(texts[i])
        assert all(e <= b or x <= a for a, x in mine for b, _, e in fixed)  # an added span touches no base span
        assert all(p[1] <= q[0] for p, q in zip(sorted(mine), sorted(mine)[1:]))


def test_every_span_is_an_example(spark):
    """However many there are, and the balance of a kind stays as it is with few."""
    texts = [f"mail a{i}@b{i}.org now, number {10**15 + i} or more" for i in range(1500)]
    told = pii.free_of_base(pii.spans(frame(spark, [*texts, *texts])).where("kind is not null"))
    by = {(r["kind"], r["free"]): r for r in pii.examples(told).groupBy("kind", "free").agg(F.count_distinct("match").alias("n"), F.sum("weight").alias("w")).collect()}
    assert by["email", False]["n"] >= 1500 and by["card", True]["n"] >= 1200
    assert abs(by["card", True]["w"] - pii.FIT_FREE) < 1e-6 and by["email", False]["w"] <= 9 * pii.FIT_BASE


def test_redaction(spark):
    df = frame(spark, ["mail a.b@c.de now, or 10.0.0.1", None, "é+1 (234) 567-8901!"])
    got = df.join(pii.find(df).withColumnRenamed("id", "doc_id").select("doc_id", "spans"), "doc_id").select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("r")).collect()
    assert {r["doc_id"]: r["r"] for r in got} == {0: "mail <email> now, or <ip>", 1: None, 2: "é<phone>!"}


def test_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_pii(spark, SF).collect()}
    docs = rows("documents", "doc_id", "text")
    assert len(got) == len(docs)
    for d in docs:
        r, mine = got[d["doc_id"]], base(d["text"])
        said = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in mine]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for _, x, _ in mine) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(said) <= set(spans) and spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))


def test_no_python_in_the_plan(spark):
    plan = queries.op11_pii(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow|MapInPandas", plan)
