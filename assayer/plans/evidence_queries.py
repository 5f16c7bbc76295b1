"""Registered queries on evidence: all tiers of the cascade, and claims sought in whole texts.

Each has the same in DuckDB SQL, and reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import privacy as P
from assayer.functions import scores as S
from assayer.functions import text as T
from assayer.operators import layout, locating, matching, normalising, ranges, rules, scoring, sections, sharing
from assayer.plans.queries import _COVERAGE, ORIGIN_NAMES, RATIO, _band, _even, _gate, layout_spans, query, requirements, strings
from assayer.sources import frames, tables
from assayer.sources.kept import keep

#: Names for skills of test rows: parts have none that are long enough for typing errors.
NAMES = ["kubernetes", "postgresql", "terraform", "javascript", "typescript", "elasticsearch", "flask", "slack", "docker", "ansible", "jenkins", "graphql"]
EDGES = [(NAMES[i], NAMES[(i + k) % 12], k) for i in range(12) for k in (1, 3)]
_AROUND = "' ' || chr(9) || '•-–—*·.,;:'"


def _named(number):
    return F.get(F.array(*map(F.lit, NAMES)), number.cast("int"))


def named_skills(spark, d) -> DataFrame:
    """Skills of an order: one a line item, with its part's name."""
    r = tables.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    origin = F.get(F.array(*map(F.lit, ORIGIN_NAMES)), (F.col("l_suppkey") % 7).cast("int"))
    return r.select(F.col("l_orderkey").alias("pair_id"), _named(F.col("l_partkey") % 12).alias("canonical"), origin.alias("origin"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("ord"), F.col("l_quantity").cast("long").alias("months"))


def order_documents(spark, d) -> DataFrame:
    """The document of each order, by turns."""
    n = tables.table(spark, d, "documents").agg(F.count("*").alias("n"))
    return tables.table(spark, d, "orders").join(F.broadcast(n)).select(F.col("o_orderkey").alias("pair_id"), "o_custkey", (F.col("o_orderkey") % F.col("n")).alias("document_id"))


def asked(spark, d) -> DataFrame:
    """Five requirements an order: a skill by name, one misspelt, one whose text the taxonomy has (and no skill is called), and two in words."""
    heads = tables.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.substring("text", 1, 60).alias("text"))
    o = order_documents(spark, d).join(heads, "document_id", "left").drop("document_id").repartition("pair_id")  # before an order becomes five rows
    rows = o.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(5)]))).withColumn("name", _named((F.col("o_custkey") + F.col("k") * 5) % 12))
    words = F.regexp_replace(F.substring("text", 11, 40), " ", "  ")
    text = F.when(F.col("k") == 0, F.initcap("name")).when(F.col("k") == 1, F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)"))).when(F.col("k") == 2, F.concat("name", F.lit("z"))).when(F.col("k") == 3, F.concat(F.lit("• "), words, F.lit(";"))).otherwise(F.concat(F.substring("text", 3, 30), F.lit(" ?!")))
    return rows.select("pair_id", F.col("k").cast("long").alias("requirement_id"), F.lit(None).cast("string").alias("canonical"), text.alias("text"), F.when(F.col("k") == 1, 2.0).alias("years"), F.when(F.col("k") > 2, "responsibility").otherwise("tool").alias("category"))


_RANK = "CASE origin " + " ".join(f"WHEN '{k}' THEN {r}" for k, (_, r) in S.ORIGINS.items()) + " END"
_STRENGTH = "CASE origin " + " ".join(f"WHEN '{k}' THEN {s}::DOUBLE" for k, (s, _) in S.ORIGINS.items()) + " END"


@query(f"""WITH names AS (SELECT {strings(NAMES)} AS n), edges(skill, near, ord) AS (VALUES {", ".join(f"('{a}', '{b}', {o})" for a, b, o in EDGES)}
), skills AS (SELECT l_orderkey AS pair_id, n[CAST(l_partkey % 12 AS INTEGER) + 1] AS canonical, {strings(ORIGIN_NAMES)}[CAST(l_suppkey % 7 AS INTEGER) + 1] AS origin, l_linenumber * 1000 + l_partkey % 1000 AS ord, CAST(l_quantity AS BIGINT) AS months FROM lineitem, names
), texts AS (SELECT o_orderkey AS pair_id, text FROM orders JOIN documents ON doc_id = o_orderkey % (SELECT count(*) FROM documents)
), asked AS (SELECT o_orderkey AS pair_id, k AS requirement_id, text AS document, n[CAST((o_custkey + k * 5) % 12 AS INTEGER) + 1] AS name FROM orders LEFT JOIN texts ON pair_id = o_orderkey, names, range(5) AS r(k)
), said AS (SELECT pair_id, requirement_id, document, CASE WHEN requirement_id = 1 THEN 2.0 END AS years, CASE requirement_id WHEN 0 THEN name WHEN 1 THEN name[1:3] || name[5:] WHEN 2 THEN name || 'z' WHEN 3 THEN '• ' || replace(document[11:50], ' ', '  ') || ';' ELSE document[3:32] || ' ?!' END AS target, CASE WHEN requirement_id < 3 THEN name END AS name FROM asked
), best AS (SELECT pair_id, canonical, first({_STRENGTH} ORDER BY {_RANK} DESC, ord) AS strength, first(origin ORDER BY {_RANK} DESC, ord) AS origin, first(ord ORDER BY {_RANK} DESC, ord) AS ord, sum(months)::BIGINT AS months FROM skills GROUP BY ALL
), known AS (SELECT s.*, CASE WHEN requirement_id = 0 THEN name END AS canonical FROM said s
), direct AS (SELECT k.*, b.strength, b.origin, b.months FROM known k LEFT JOIN best b USING (pair_id, canonical)
), pairs AS (SELECT s, t, {RATIO} AS ratio FROM (SELECT DISTINCT target AS s FROM said WHERE requirement_id IN (1, 2)), (SELECT DISTINCT canonical AS t FROM skills)
), near AS (SELECT d.pair_id, d.requirement_id, first(t ORDER BY ratio DESC, b.ord) AS skill FROM direct d JOIN pairs p ON d.target = p.s JOIN best b ON b.pair_id = d.pair_id AND b.canonical = p.t WHERE d.strength IS NULL AND d.requirement_id IN (1, 2) AND ratio >= 82 GROUP BY ALL
), fuzzy AS (SELECT d.pair_id, d.requirement_id, d.document, d.target, d.years, d.canonical, coalesce(d.strength, b.strength) AS strength, coalesce(d.origin, b.origin) AS origin, coalesce(d.months, 0) AS months, CASE WHEN d.strength IS NOT NULL THEN 'exact' WHEN b.strength IS NOT NULL THEN 'fuzzy' END AS tier, CASE WHEN d.strength IS NOT NULL THEN d.canonical ELSE n.skill END AS skill
  FROM direct d LEFT JOIN near n USING (pair_id, requirement_id) LEFT JOIN best b ON b.pair_id = d.pair_id AND b.canonical = n.skill
), lit AS (SELECT * REPLACE (CASE WHEN hit THEN {S.ORIGINS['other'][0]} ELSE strength END AS strength, CASE WHEN hit THEN 'other' ELSE origin END AS origin, CASE WHEN hit THEN 'literal' ELSE tier END AS tier) FROM (
  SELECT *, tier IS NULL AND requirement_id > 2 AND length(trim(target)) >= 4 AND (strpos(document, target) > 0 OR strpos(document, trim(target, {_AROUND})) > 0 OR strpos(trim(regexp_replace(document, '\\s+', ' ', 'g')), trim(regexp_replace(trim(target, {_AROUND}), '\\s+', ' ', 'g'))) > 0) AS hit FROM fuzzy)
), beside AS (SELECT d.pair_id, d.canonical, first(e.near ORDER BY e.ord, e.near) AS via FROM (SELECT DISTINCT pair_id, canonical FROM lit WHERE strength IS NULL) d JOIN edges e ON e.skill = d.canonical JOIN best s ON s.pair_id = d.pair_id AND s.canonical = e.near GROUP BY ALL
), adj AS (SELECT l.*, via, CASE WHEN strength IS NULL OR years IS NULL OR months >= years * 12 THEN strength WHEN months / (years * 12) >= 0.6 THEN least(strength, 0.6) ELSE least(strength, 0.3) END AS s FROM lit l LEFT JOIN beside b ON l.strength IS NULL AND l.pair_id = b.pair_id AND l.canonical = b.canonical)
SELECT pair_id, requirement_id, coalesce(s, CASE WHEN via IS NOT NULL THEN 0.4 END, 0.0)::DOUBLE AS strength, CASE WHEN s > 0.5 THEN 'matched' WHEN s IS NOT NULL OR via IS NOT NULL THEN 'partial' ELSE 'missing' END AS status, origin, coalesce(tier, CASE WHEN via IS NOT NULL THEN 'adjacent' END) AS tier, coalesce(skill, via) AS skill FROM adj""")
def cascade_tiers(spark, d):
    """All tiers: names of the taxonomy, typing errors in the document's own skills, wordings, neighbours."""
    edges = spark.createDataFrame(EDGES, "skill string, near string, ord int")
    known = spark.createDataFrame([(n, n, i) for i, n in enumerate(NAMES)], "canonical string, alias string, ord int")
    texts = tables.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    rows = asked(spark, d)
    exact = keep(matching.canonical(rows.drop("canonical"), known, "text"), "cascade-requirements")  # read by several tiers
    return matching.cascade(exact, named_skills(spark, d), edges, documents=texts, explain=True, shared=order_documents(spark, d).drop("o_custkey")).select("pair_id", "requirement_id", "strength", "status", "origin", "tier", "skill")


def claims(spark, d) -> DataFrame:
    """Every line of every document as a claim: as it is, with other marks around it, with other blanks, or with a word that isn't there."""
    lines = tables.dealt_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "said")).where(F.length("said") >= 12)
    claim = F.when(F.col("line") % 4 == 1, F.concat(F.lit("– "), "said", F.lit(" ;"))).when(F.col("line") % 4 == 2, F.concat(F.lit("* "), F.regexp_replace("said", " ", "\t "))).when(F.col("line") % 4 == 3, F.concat("said", F.lit(" unsaid"))).otherwise(F.col("said"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), claim.alias("needle"))


@query(f"""WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), claims AS (SELECT doc_id, text, line, CASE line % 4 WHEN 1 THEN '– ' || said || ' ;' WHEN 2 THEN '* ' || replace(said, ' ', chr(9) || ' ') WHEN 3 THEN said || ' unsaid' ELSE said END AS needle FROM lines WHERE length(said) >= 12
), forms AS (SELECT *, trim(needle, {_AROUND}) AS bare, strpos(text, needle) AS a FROM claims
), found AS (SELECT *, CASE WHEN bare <> '' THEN strpos(text, bare) ELSE 0 END AS b, array_to_string(list_transform(list_filter(string_split_regex(bare, '\\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\\s+') AS pattern FROM forms
), placed AS (SELECT *, CASE WHEN a = 0 AND b = 0 AND pattern <> '' THEN regexp_extract(text, pattern) ELSE '' END AS c FROM found)
SELECT doc_id, line, CASE WHEN a > 0 THEN 'exact' WHEN b > 0 THEN 'trimmed' ELSE 'collapsed' END AS form, CASE WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 ELSE strpos(text, c) - 1 END::BIGINT AS start, CASE WHEN a > 0 THEN a - 1 + length(needle) WHEN b > 0 THEN b - 1 + length(bare) ELSE strpos(text, c) - 1 + length(c) END::BIGINT AS "end"
FROM placed WHERE a > 0 OR b > 0 OR c <> ''""")
def claims_located(spark, d):
    """Every claim in its own document, all of a document's at once."""
    docs = tables.dealt_table(spark, d, "documents").select("doc_id", "text")
    out = locating.located(docs, claims(spark, d), ["doc_id"], "line")
    return out.select("doc_id", "line", "form", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, unnest(string_split(text, chr(10))) AS s FROM documents
), p AS (SELECT doc_id, k, 0 AS j, 'S K I L L S' AS raw FROM l WHERE k % 4 = 1
  UNION ALL SELECT doc_id, k, 1, CASE k % 4 WHEN 0 THEN '● ' || replace(s, ' ', '  ') WHEN 1 THEN s || '  ' WHEN 2 THEN 'ﬁne auto-' || chr(10) || 'mation ' || s ELSE s END FROM l
), o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS line, count(*) FILTER (j = 0) OVER (PARTITION BY doc_id) AS repairs FROM p)
SELECT doc_id, line, a AS start, a + length(rtrim(raw)) AS "end", md5(CASE WHEN j = 0 THEN 'SKILLS' WHEN k % 4 = 0 THEN rtrim('• ' || replace(raw[3:], '  ', ' ')) WHEN k % 4 = 2 THEN rtrim('fine automation ' || raw[18:]) ELSE rtrim(raw) END) AS said, repairs FROM o WHERE trim(raw) <> ''""")
def normalised_spans(spark, d):
    """Every document with ligatures, bullets, double blanks, cut words and spaced headings put in; each line of the normalised text points at its place in the other."""
    line = lambda s, k: F.when(k % 4 == 0, F.concat(F.lit("● "), F.replace(s, F.lit(" "), F.lit("  ")))).when(k % 4 == 1, F.concat(F.lit("S K I L L S\n"), s, F.lit("  "))).when(k % 4 == 2, F.concat(F.lit("ﬁne auto-\nmation "), s)).otherwise(s)
    rough = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    out = normalising.normalised(tables.dealt_table(spark, d, "documents").select("doc_id", rough.alias("text")))
    # within the row, as a line that leaves it would take all the pieces of its text along
    parts = out.select("id", "at", "source", "repairs", F.split("normalised", "\n", -1).alias("parts"))
    parts = parts.select("*", F.transform("parts", lambda p: F.length(p) + 1).alias("lengths"))
    parts = parts.select("id", "at", "source", "repairs", "parts", T.starts(F.col("lengths")).alias("firsts"))
    numbered = F.transform(F.arrays_zip("parts", "firsts"), lambda x, i: F.struct(i.cast("long").alias("line"), x["firsts"].cast("int").alias("first"), x["parts"].alias("said")))
    span = lambda x: normalising.original_span(x["first"], x["first"] + F.length(x["said"]), F.col("at"), F.col("source"))
    each = F.transform(F.filter(numbered, lambda x: x["said"] != ""), lambda x: F.struct(x["line"].alias("line"), span(x).alias("span"), F.md5(x["said"].cast("binary")).alias("said")))
    lines = parts.select("id", "repairs", F.inline_outer(each)).where(F.col("line").isNotNull())
    return lines.select(F.col("id").alias("doc_id"), "line", F.col("span.start").cast("long").alias("start"), F.col("span.end").cast("long").alias("end"), "said", F.col("repairs").cast("long").alias("repairs"))


def pieces(rows: DataFrame, by: str, pattern: str, name: str, words: bool = False) -> DataFrame:
    """The parts of each text that ``pattern`` divides, with their places: key, ``name`` (number), ``start``, ``end``; ``words``: only parts that aren't blank. Found within the row, so no text is shuffled."""
    parts = rows.select(by, F.split("text", pattern, -1).alias("parts"))
    parts = parts.select(by, "parts", F.transform("parts", F.length).alias("lengths")).select(by, "parts", T.starts(F.col("lengths")).alias("starts"))
    each = F.transform("parts", lambda p, i: F.struct(i.cast("long").alias(name), F.get("starts", i).cast("long").alias("start"), (F.get("starts", i) + F.length(p)).cast("long").alias("end"), F.trim(F.replace(p, F.lit("\n"), F.lit(" "))).alias("said")))
    each = F.filter(each, lambda x: x["said"] != "") if words else each
    # outer, as Spark else computes the whole array twice more to leave out rows without parts
    return parts.select(by, F.inline_outer(each)).where(F.col("start").isNotNull()).drop("said")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^ \n]+')) AS gap, generate_subscripts(regexp_split_to_array(text, '[^ \n]+'), 1) AS n FROM documents
), v AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ \n]+'), 1) AS n FROM documents
), p AS (SELECT doc_id, n, sum(length(gap) + coalesce(length(word), 0)) OVER (PARTITION BY doc_id ORDER BY n) - length(word) AS place FROM w JOIN v USING (doc_id, n)
), l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS s FROM documents
), i AS (SELECT doc_id, line, (sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(s) - 1)::BIGINT AS a, length(s) AS size FROM l)
SELECT doc_id, line, count(*) AS n_words, sum(place - a)::BIGINT AS places FROM p JOIN i USING (doc_id) WHERE place >= a AND place < a + size GROUP BY ALL""")
def lines_of_words(spark, d):
    """The line that each word of each document begins in, by a range join of places with lines: words of each line, and the sum of their columns."""
    docs = tables.dealt_table(spark, d, "documents").select("doc_id", "text")
    lines = pieces(docs, "doc_id", r"(?<=\n)", "line")
    words = pieces(docs, "doc_id", r"(?<=[ \n])(?=[^ \n])|(?<=[^ \n])(?=[ \n])", "number", words=True).select("doc_id", F.col("start").alias("at"))
    met = ranges.points_in_intervals(words, lines, ["doc_id"], "at", "start", "end")
    return met.groupBy("doc_id", "line").agg(F.count("*").alias("n_words"), F.sum(F.col("at") - F.col("start")).alias("places"))


@query("""SELECT l_orderkey, l_linenumber, printf('%.1f', l_extendedprice * l_discount)::DOUBLE AS one, printf('%.2f', l_extendedprice * (1 - l_discount))::DOUBLE AS two, printf('%.0f', l_quantity * 0.5)::DOUBLE AS none FROM lineitem""")
def exact_rounding(spark, d):
    """Amounts rounded by their exact binary values."""
    rows = tables.table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", S.round_half_even(price * F.col("l_discount"), 1).alias("one"), S.round_half_even(price * (1 - F.col("l_discount")), 2).alias("two"), S.round_half_even(F.col("l_quantity") * 0.5).alias("none"))


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS event, event_id FROM events""")
def chunked_frames(spark, d):
    """Every user's events as one text of frames, cut into chunks of seven characters, and read back from the chunks."""
    events = tables.table(spark, d, "events").select("user_id", "ts", "event_id", frames.frame(F.col("event_type"), F.to_json(F.struct("event_id"))).alias("frame"))
    # a number of partitions that stays: merged by the bytes of frames, they would be too few for the chunks that come of them
    events = events.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "frame"))), lambda e: e["frame"]), "")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 7).cast("int")), lambda k: F.substring(F.col("text"), k * 7 + 1, F.lit(7)))
    chunks = events.groupBy("user_id").agg(text.alias("text")).select("user_id", F.posexplode(cut).alias("seq", "chunk"))
    out = frames.parsed(frames.from_chunks(chunks, "user_id"), "user_id", "event_id long")
    return out.select("user_id", F.col("pos").cast("long").alias("pos"), "event", "data.event_id")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS s FROM documents
), m AS (SELECT doc_id, line * 2 + k AS n, CASE k WHEN 1 THEN lower(s) || '.' ELSE CASE line % 5 WHEN 1 THEN 'Experience' WHEN 3 THEN 'Skills' WHEN 4 THEN 'Education' ELSE '' END END AS t, k = 0 AND line % 5 IN (1, 3, 4) AS head FROM l, (SELECT unnest([0, 1]) AS k)
), o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a, (sum(length(t) + 1) OVER (PARTITION BY doc_id) - 1)::BIGINT AS size FROM m
), h AS (SELECT doc_id, lower(t) AS kind, t AS heading, least(a + length(t) + 1, coalesce(lead(a) OVER w, size)) AS start, coalesce(lead(a) OVER w, size) AS "end" FROM o WHERE head WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), c AS (SELECT doc_id, 'contact' AS kind, NULL AS heading, 0::BIGINT AS start, coalesce(min(a) FILTER (head), max(size)) AS "end" FROM o GROUP BY doc_id)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") - 1 AS ord FROM (SELECT * FROM h UNION ALL SELECT * FROM c)""")
def section_bounds(spark, d):
    """Headings put between the lines of every document, and the sections that they make, with their places."""
    named = lambda i: F.when(i % 5 == 1, "Experience").when(i % 5 == 3, "Skills").when(i % 5 == 4, "Education").otherwise("")
    lines = F.flatten(F.transform(F.split("text", "\n", -1), lambda s, i: F.array(named(i), F.concat(F.lower(s), F.lit(".")))))
    out = sections.sections(tables.table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")))
    return out.select("doc_id", "kind", "heading", "start", "end", F.col("ord").cast("long").alias("ord"))


@query("""WITH t AS (SELECT doc_id, doc_id % 3 AS mode, 'By Ada Smith: "' || replace(left(text, 40), '"', '') || '" said ADA SMITH. ' || text AS t FROM documents
), s AS (SELECT *, replace(replace(t, 'Ada Smith', '[redacted]'), 'ADA SMITH', '[redacted]') AS clean FROM t)
SELECT doc_id, md5(CASE mode WHEN 0 THEN t WHEN 1 THEN clean ELSE regexp_replace(clean, '["“][^"“”]{10,}["”]', '…', 'g') END) AS said FROM s""")
def shared_modes(spark, d):
    """Every document shared in one of three modes: whole, without a name, and without the name and quotes."""
    mode = F.get(F.array(*map(F.lit, sharing.MODES)), (F.col("doc_id") % 3).cast("int"))
    text = F.concat(F.lit('By Ada Smith: "'), F.replace(F.left("text", F.lit(40)), F.lit('"'), F.lit("")), F.lit('" said ADA SMITH. '), "text")
    rows = tables.dealt_table(spark, d, "documents").select("doc_id", mode.alias("visibility_mode"), text.alias("said"), F.array(F.lit("Ada Smith")).alias("secrets"))
    return sharing.redact_free_text(rows, ["said"]).select("doc_id", F.md5(F.col("said").cast("binary")).alias("said"))


@query("""SELECT o_orderkey AS analysis_id, 'scores_only' AS visibility_mode, o_totalprice AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY greatest(1, least(30, o_orderkey % 40)) DESC, o_orderkey) AS nth FROM orders WHERE o_orderkey % 7 <> 0 AND greatest(1, least(30, o_orderkey % 40)) > 10""")
def links_resolved(spark, d):
    """Reports behind the links that still live ten days on, when some have been revoked; each user's, the longest-lived first."""
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    orders = tables.table(spark, d, "orders")
    made = sharing.new_links(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 40).cast("int").alias("days")), now, F.col("days"), F.lit("scores_only"), "k")
    links = made.withColumn("revoked_at", F.when(F.col("analysis_id") % 7 == 0, now + F.expr("interval 1 day")))
    out = sharing.resolve(links, orders.select(F.col("o_orderkey").alias("analysis_id"), "o_custkey", "o_totalprice"), now + F.expr("interval 10 days")).join(links.select("token", "expires_at"), "token")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("expires_at"), "analysis_id")
    return out.select("analysis_id", "visibility_mode", F.col("o_totalprice").alias("total"), F.row_number().over(order).cast("long").alias("nth"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector, (SELECT count(*) FROM embeddings) AS n FROM embeddings
), k AS (SELECT doc_id, left(sha256(lower(trim(text))), 32) AS key, text FROM documents WHERE trim(text) <> ''
), made AS (SELECT key, doc_id, vec_id, n FROM k JOIN v ON vec_id = doc_id % n
), c AS (SELECT key, min(vec_id) AS vec_id FROM made WHERE doc_id % 4 = 0 GROUP BY key
), w AS (SELECT key, min(vec_id) AS vec_id FROM made WHERE doc_id % 4 IN (1, 2) GROUP BY key
), whole AS (SELECT * FROM c UNION ALL SELECT * FROM w ANTI JOIN c USING (key))
SELECT d.doc_id, whole.vec_id FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN whole ON whole.key = k.key""")
def vectors_of_texts(spark, d):
    """Vectors for half of the texts written back to a cache that has a quarter of them, and all texts joined with what it then has. A vector is told by its number here."""
    docs = tables.table(spark, d, "documents").select("doc_id", "text")
    n = tables.table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    vectors = tables.table(spark, d, "embeddings").select("vec_id")
    made = docs.where(F.trim("text") != "").join(F.broadcast(n)).select("doc_id", P.embedding_key(F.col("text")).alias("key"), (F.col("doc_id") % F.col("n")).alias("vec_id")).join(vectors, "vec_id")
    cache = made.where("doc_id % 4 = 0").groupBy("key").agg(F.min("vec_id").alias("vector"))
    whole = sharing.written_back(cache, made.where("doc_id % 4 IN (1, 2)").select("key", F.col("vec_id").alias("vector")))
    return sharing.with_vectors(docs, whole, "text").select("doc_id", F.col("vector").alias("vec_id"))


@query(f"""WITH {_COVERAGE}, rubric(version, priority, weight) AS (VALUES ('default', 'must', 3.0), ('default', 'strong', 2.0), ('default', 'nice', 1.0), ('strict', 'must', 4.0), ('strict', 'strong', 1.5), ('strict', 'nice', 0.5)
), s AS (SELECT version, pair_id, sum(weight * r.strength)::DOUBLE / sum(weight)::DOUBLE * 100 AS raw, coalesce(sum(weight * r.strength) FILTER (priority = 'must')::DOUBLE / sum(weight) FILTER (priority = 'must')::DOUBLE, 1.0) AS mc FROM requirements r JOIN rubric USING (priority) GROUP BY ALL
), c AS (SELECT *, ({_gate("raw", "mc")})::DOUBLE AS capped FROM s)
SELECT version, pair_id, {_even("capped")} AS job_match, {_band("capped")} AS band FROM c""")
def rubric_coverage(spark, d):
    """Every order's coverage under two versions of the rubric, which is a table."""
    strict = spark.createDataFrame([("strict", "priority", n, w) for n, w in (("must", 4.0), ("strong", 1.5), ("nice", 0.5))], "version string, section string, name string, weight double")
    rows = scoring.weighted(requirements(spark, d), scoring.rubric(spark).unionByName(strict))
    return scoring.coverage(rows, ["version", "pair_id"]).select("version", "pair_id", "job_match", "band")


_SEEN = ["text_in_table", "text_as_image", "content_in_header_footer", "informative_graphics", "exotic_fonts", "hidden_text"]


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS s FROM documents
), d AS (SELECT doc_id, max(i // 40) AS last_page, count(*) FILTER (i % 11 = 0 AND trim(s) <> '') > 0 AS pale FROM l GROUP BY doc_id
), f AS (SELECT doc_id, unnest([CASE WHEN doc_id % 3 = 0 AND last_page > 0 THEN 'text_in_table' END, CASE WHEN doc_id % 6 = 2 THEN 'text_as_image' END, 'content_in_header_footer', CASE WHEN doc_id % 6 <> 2 AND (doc_id % 4 = 1 OR doc_id % 5 = 4 AND last_page >= 2) THEN 'informative_graphics' END, CASE WHEN doc_id % 7 = 0 THEN 'exotic_fonts' END, CASE WHEN pale THEN 'hidden_text' END]) AS rule_id FROM d)
SELECT doc_id, f.rule_id, severity, deduction FROM f JOIN (VALUES {", ".join(f"('{r.rule_id}', '{r.severity}', {float(r.deduction)}::DOUBLE)" for r in rules.RULES)}) AS r(rule_id, severity, deduction) USING (rule_id)""")
def layout_findings(spark, d):
    """The checks that go by layout, on signals of every document's positioned spans and of blocks put on its pages."""
    spans = layout_spans(spark, d).withColumn("font", F.when(F.col("doc_id") % 7 == 0, "Papyrus").otherwise(F.col("font")))
    pages = spans.select("doc_id", "page").distinct()
    block = lambda kind, share, n: F.struct(F.lit(kind).alias("kind"), F.lit(share).alias("area_share"), n.cast("int").alias("rows"))
    first, i = F.col("page") == 0, F.col("doc_id")
    made = F.array_compact(F.array(block("text", 0.3, F.lit(0)), F.when(i % 3 == 0, block("table", 0.1, F.col("page") + 1)), F.when((i % 6 == 2) & first, block("image", 0.95, F.lit(0))), *[F.when((i % 4 == 1) & first, block("image", 0.01, F.lit(0)))] * 3, F.when(i % 5 == 4, block("image", 0.01, F.lit(0)))))
    blocks = pages.select("doc_id", "page", F.explode(made).alias("b")).select("doc_id", "page", "b.*")
    return rules.findings(layout.signals(spans, blocks), rules=[r for r in rules.RULES if r.rule_id in _SEEN]).drop("ord")
