"""PII (operator 2): patterns find personal data, and corpus co-occurrence finds the terms that give it away.

Native: DataFrame and SQL functions only.

A match's place is the length of all that split() leaves before it. Protected entities are the values that the patterns
find. A term t discloses an entity e if their pointwise mutual information is at least DISCLOSURE times the information
content of e, that is if P(e|t) >= P(e) ** (1 - DISCLOSURE), where t, outside of entities, and e stand in SUPPORT different
texts at least, however far from each other. All counts are over the documents of the whole corpus. In every document that holds e, t is generalised to
[TERM], wherever it stands, and the entities to the names of their kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import prepare, stored, table

SUPPORT, DISCLOSURE = 3, 0.9
#: Kinds in the order of results, with patterns that match what the plain ones match but never step back over a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must hold to be worth a kind's pattern.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[\p{L}\p{N}]+"
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
#: Prefix sums go by blocks of so many, so that a text of n matches costs n ** 1.5 at most.
BLOCK = 256
SPAN = "array<struct<s:int,e:int,v:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubles every second digit from the right; for 16 to 19 digits only."""
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        d = _digits(m)
        return F.when((F.length(m) <= 40) & F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def value(kind: str, m: Column) -> Column:
    return F.lower(m) if kind in ("email", "ip") else _digits(m)


def ends(lengths: Column) -> Column:
    """Prefix sums of an array of integers."""
    n = F.size(lengths)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))

    def within(x: Column, first: Column) -> Column:
        summed = F.aggregate(x, F.array().cast("array<int>"), lambda acc, y: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), first) + y)))
        return summed

    def step(acc: Column, x: Column) -> Column:
        done = within(x, acc.total)
        return F.struct(F.element_at(done, -1).alias("total"), F.concat(acc.out, F.array(done)).alias("out"))

    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(blocks, start, step, lambda acc: acc.out))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds, for each kind, an array of its valid spans: start, end (exclusive, code points) and value."""
    for kind in KINDS:
        sign = SIGNS[kind]
        none = F.array().cast("array<string>")
        found = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
        docs = docs.withColumn("_m", F.when(F.contains(F.col(text), F.lit(sign)), found).otherwise(none) if sign else found)
        docs = docs.withColumn("_some", F.exists("_m", lambda m: valid(kind, m)))  # noqa: B023
        docs = docs.withColumn("_p", F.when(F.col("_some"), F.split(F.col(text), PATTERNS[kind], -1)).otherwise(none))
        docs = docs.withColumn("_n", F.when(F.col("_some"), F.zip_with(F.slice("_p", 1, F.size("_m")), "_m", lambda p, m: F.length(p) + F.length(m))).otherwise(F.array().cast("array<int>")))
        docs = docs.withColumn("_e", F.when(F.col("_some"), ends(F.col("_n"))).otherwise(F.array().cast("array<int>")))

        def span(m: Column, i: Column) -> Column:
            e = F.element_at("_e", i + 1)
            ok = valid(kind, m)  # noqa: B023
            return F.when(ok, F.struct((e - F.length(m)).alias("s"), e.alias("e"), value(kind, m).alias("v")))  # noqa: B023

        spans = F.filter(F.transform("_m", span), lambda s: s.isNotNull())
        docs = docs.withColumn(f"_{kind}", F.when(F.col("_some"), spans).otherwise(F.array().cast(SPAN)))
    return docs.drop("_m", "_some", "_p", "_n", "_e")


def _entities() -> Column:
    """All spans of a row, with the place of their kind in KINDS."""
    return F.concat(*(F.transform(f"_{k}", lambda s: F.struct(F.lit(i).alias("k"), s.v.alias("v"))) for i, k in enumerate(KINDS)))  # noqa: B023


def disclosing(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Entities (k, v) and the terms that disclose them, from rows with their entities and the texts of the whole corpus."""
    held = found.where(F.size("ents") > 0)
    once = held.groupBy("text_key").agg(F.min("rid").alias("rid"), F.count("*").alias("n")).select("rid", "n")  # a row of each text
    rows = stored(held.select("rid", F.explode(F.array_distinct("ents")).alias("x")).join(once, "rid").select("rid", "n", "x.k", "x.v"), "pii-entities")
    n_e = rows.groupBy("k", "v").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).drop("texts")
    ents = rows.join(n_e, ["k", "v"]).groupBy("rid", "n").agg(F.collect_list(F.struct("k", "v")).alias("often"))
    texts = masked(held.join(ents, "rid"), lambda _: " ").select("n", "often", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("t")).where("t != ''")
    pairs = texts.select("n", F.explode("often").alias("x"), "t").groupBy("x.k", "x.v", "t").agg(F.sum("n").alias("n_et"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    pairs = stored(pairs, "pii-pairs")
    words = corpus.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("t"))
    n_t = words.groupBy("t").agg(F.count("*").alias("n_t"))  # counted before the join, where common words have shrunk to a row
    total = F.lit(float(found.count()))
    p_et, p_e = F.col("n_et") / F.col("n_t"), F.col("n_e") / total
    return pairs.join(n_t, "t").join(n_e, ["k", "v"]).where(p_et >= F.pow(p_e, F.lit(1 - DISCLOSURE))).select("k", "v", "t")


def find(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Rows of docs with the spans of each kind (s, e), those of disclosing terms, and the row's terms.

    docs needs doc_id and text; a null text counts as empty. Each row of docs gives one row, repeated ones as well. With
    keep_text all its columns come along; else doc_id alone.
    """
    prepare(docs.sparkSession)
    rows = docs if keep_text else docs.select("doc_id", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    seen = detect(rows).withColumn("ents", _entities())
    seen = seen.withColumn("has", F.size("ents") > 0).withColumn("text_key", F.when(F.col("has"), F.xxhash64("text")))
    if not keep_text:
        seen = seen.withColumn("text", F.when(F.col("has"), F.col("text")))
    found = stored(seen.withColumn("rid", F.monotonically_increasing_id()), "pii")
    flagged = stored(disclosing(found, docs.select(F.coalesce("text", F.lit("")).alias("text"))), "pii-terms")
    own = found.where("has").select("rid", F.explode("ents").alias("x")).select("rid", "x.k", "x.v").distinct().join(flagged, ["k", "v"]).groupBy("rid").agg(F.collect_set("t").alias("terms"))
    out = found.join(own, "rid", "left").withColumn("_w", F.when(F.col("terms").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    out = out.withColumn("_g", F.when(F.col("terms").isNotNull(), F.split("text", WORD, -1)))
    out = out.withColumn("_e", F.when(F.col("terms").isNotNull(), ends(F.zip_with(F.slice("_g", 1, F.size("_w")), "_w", lambda g, w: F.length(g) + F.length(w)))))
    base = F.concat(*(F.transform(f"_{k}", lambda s: F.struct(s.s.alias("s"), s.e.alias("e"))) for k in KINDS))
    marked = F.filter(F.transform("_w", lambda w, i: F.struct((F.element_at("_e", i + 1) - F.length(w)).alias("s"), F.element_at("_e", i + 1).alias("e"), w.alias("w"))), lambda x: F.array_contains("terms", F.lower(x.w)))
    clear = F.filter(marked, lambda x: ~F.exists(base, lambda b: (b.s < x.e) & (x.s < b.e)))
    return out.withColumn("_term", F.coalesce(clear, F.array().cast("array<struct<s:int,e:int,w:string>>"))).drop("_w", "_g", "_e", "ents", "has", "text_key")


def _joined(kinds: tuple[str, ...]) -> Column:
    parts = F.concat(*(F.transform(f"_{k}", lambda s: F.concat_ws(":", F.lit(k), s.s.cast("string"), s.e.cast("string"))) for k in kinds))  # noqa: B023
    return F.array_join(parts, ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans, digest of the base spans and all spans as text."""
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(_joined(KINDS), 256).alias("base_sha256"), _joined((*KINDS, "term")).alias("spans"))


def masked(found: DataFrame, name: Callable[[str], str]) -> DataFrame:
    """found with the valid spans in text replaced by the names of their kinds."""
    for kind in ("email", "phone", "card", "ip"):
        hit = F.size(f"_{kind}") > 0
        found = found.withColumn("_m", F.when(hit, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)))).withColumn("_p", F.when(hit, F.split("text", PATTERNS[kind], -1)))
        parts = F.transform("_m", lambda m: F.when(valid(kind, m), F.lit(name(kind))).otherwise(m))  # noqa: B023
        found = found.withColumn("text", F.when(hit, _woven(F.col("_p"), parts)).otherwise(F.col("text")))
    return found


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the spans of personal data in text replaced by [EMAIL], [IP], [CARD] and [PHONE], and those of disclosing terms by [TERM].

    The text is built once, from the spans that report() tells; spans of base kinds that overlap are replaced as one, by the
    name of the first. n_chars, if there, follows. A null text becomes empty.
    """
    found = find(docs, keep_text=True)
    spans = F.array_sort(F.concat(*(F.transform(f"_{k}", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(f"[{k.upper()}]").alias("name"))) for k in (*KINDS, "term"))))  # noqa: B023
    found = found.withColumn("_all", spans).withColumn("_n", F.size("_all"))
    clash = (F.col("_n") > 1) & F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("_n"))), lambda i: F.try_element_at("_all", i).s < F.try_element_at("_all", i - 1).e)

    def merge(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last.s.alias("s"), F.greatest(last.e, x.e).alias("e"), last["name"].alias("name"))
        return F.when(last.e > x.s, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    none = F.array().cast("array<struct<s:int,e:int,name:string>>")
    found = found.withColumn("_all", F.when(clash, F.aggregate("_all", none, merge)).otherwise(F.col("_all"))).withColumn("_n", F.size("_all"))
    # BLOCK spans at a time share a part of the text, so that no place is counted from the text's beginning for each span
    first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.try_element_at("_all", k * BLOCK).e)
    last = lambda k: F.element_at("_all", F.least((k + 1) * BLOCK, F.col("_n"))).e
    part = lambda k: F.struct(first(k).alias("at"), F.substr("text", first(k) + 1, last(k) - first(k)).alias("text"), F.slice("_all", k * BLOCK + 1, F.lit(BLOCK)).alias("spans"))
    found = found.withColumn("_parts", F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK).cast("int")), part)))

    def woven(p: Column) -> Column:
        before = lambda i: F.when(i == 0, p.at).otherwise(F.try_element_at(p.spans, i).e)
        return F.array_join(F.transform(p.spans, lambda x, i: F.concat(F.substr(p.text, before(i) - p.at + 1, x.s - before(i)), x["name"])), "")

    rest = F.expr("substring(text, _all[_n - 1].e + 1)")
    found = found.withColumn("text", F.when(F.col("_n") > 0, F.concat(F.array_join(F.transform("_parts", woven), ""), rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def _woven(pieces: Column, matches: Column) -> Column:
    """pieces[0] matches[0] pieces[1] ... as one string."""
    return F.concat(F.array_join(F.flatten(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.array(p, m))), ""), F.element_at(pieces, -1))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
