"""PII spans by regular expressions, confirmed by validators and scored by nearby words. DataFrame functions only.

Patterns are proposed by split/regexp_extract_all, whose pieces give places in code points. Java's group loops recurse,
so the patterns below use loops over single character classes alone; they match what the plain forms match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leftmost matches start at the start of a run, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.[^A-Za-z0-9.-]|\.\z|[^A-Za-z0-9.-]|\z)"
IP = r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
#: What stands between two runs of digits joined by single spaces or hyphens.
BETWEEN_DIGITS = r"[^0-9]{2,}|[^0-9\x20-]|\A[\x20-]|[\x20-]\z"
#: Matches summed up at once, and code points of a block of text.
CHUNK, BLOCK = 128, 4096
PLACED = "array<struct<m:string,s:int,e:int>>"
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
#: Score of a confirmed span, what a context word adds, and how many code points before and after are looked at.
CONFIRMED = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9}
CONTEXT_ADDS, CONTEXT_REACH = 0.2, 40
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|tarjeta|karte|carte)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|telefon)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b",
}


def _let(value: Column, use) -> Column:
    """use(value), which is worked out once, also where lambdas use it for each of their items."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(found: Column, gaps: Column) -> Column:
    """array<struct<m, s, e>> of matches, of which gaps[i] stands before found[i].

    Running sums are taken within chunks and over chunks, since appending to an array copies it: this stays near linear
    for texts with a great many matches.
    """
    none = F.array().cast(PLACED)
    width = lambda x: F.length(x["g"]) + F.length(x["m"])

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), start.alias("s"), end.alias("e"))).cast(PLACED)).alias("out"))

    def from_(at: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), add)["out"]

    def next_(acc: Column, chunk: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(chunk, F.lit(0), lambda n, x: n + width(x))))

    def many(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.array(F.lit(0)), next_)
        return F.flatten(F.zip_with(F.slice(starts, 1, F.size(chunks)), chunks, from_))

    def of_pairs(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(CHUNK)), lambda i: F.slice(pairs, i, CHUNK))
        return F.when(F.size(pairs) > CHUNK, _let(chunks, many)).when(F.size(pairs) > 0, from_(F.lit(0), pairs)).otherwise(none)

    return _let(found, lambda f: _let(F.arrays_zip(f.alias("m"), F.slice(gaps, 1, F.size(f)).alias("g")), of_pairs))


def _matches(text: Column, pattern: str, hint: Column) -> Column:
    none = F.array().cast(PLACED)
    return F.when(hint, _placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))).otherwise(none)


def _digit_runs(text: Column) -> Column:
    """Runs of 13 digits or more, digits joined by single spaces or hyphens."""
    found, gaps = F.split(text, BETWEEN_DIGITS, -1), F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(BETWEEN_DIGITS), F.lit(0)))
    return F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), F.filter(_placed(found, gaps), lambda x: F.length(x["m"]) >= 13)).otherwise(F.array().cast(PLACED))


def digits_of(x: Column) -> Column:
    """The digits of a text, without what stands between them; null for null."""
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits; of 13 to 19 of them alone."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def mod97(code: Column) -> Column:
    """The check of an IBAN: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda acc, i: step(acc, F.substring(moved, i, F.lit(1))).cast("int")) == 1


def _small_part(x: Column) -> Column:
    lean = F.regexp_replace(x, "^0+", "")
    return (F.length(lean) <= 2) | ((F.length(lean) == 3) & (lean <= "255"))


def _with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """docs with __text, an array __<kind> of confirmed matches (m, s, e) for each kind, and __blocks of the text if there
    are any."""
    x = F.col("__text")
    df = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    has_digit = x.rlike("[0-9]")
    df = df.withColumns({
        "__email": _matches(x, EMAIL, F.contains(x, F.lit("@"))),
        "__ip": F.filter(_matches(x, IP, x.rlike(r"[0-9]\.[0-9]")), lambda m: F.forall(F.split(m["m"], r"\."), _small_part)),
        "__card": F.filter(_digit_runs(x), lambda m: luhn(digits_of(m["m"]))),
        "__phone": F.filter(_matches(x, PHONE, F.contains(x, F.lit("+")) & has_digit), lambda m: F.length(digits_of(m["m"])).between(9, 15)),
        "__iban": F.filter(_matches(x, IBAN, has_digit & x.rlike("[A-Z]{2}[0-9]{2}")), lambda m: mod97(m["m"])),
    })
    found = sum((F.size(f"__{k}") for k in KINDS), F.lit(0)) > 0
    return df.withColumn("__blocks", F.when(found, F.regexp_extract_all(x, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text in blocks; a whole text would be walked from its beginning for each piece."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, end - start)


def _scored(kind: str) -> Column:
    """array<struct<kind, s, e, score>> of a kind's matches."""

    def score(m: Column) -> Column:
        near = _piece(F.col("__blocks"), F.greatest(m["s"] - CONTEXT_REACH, F.lit(0)), m["e"] + CONTEXT_REACH)
        return F.lit(CONFIRMED[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_ADDS)).otherwise(F.lit(0.0))

    return F.transform(F.col(f"__{kind}"), lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("start"), m["e"].alias("end"), F.least(score(m), F.lit(1.0)).alias("score")))


def _spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with __text, __blocks, and __spans of all kinds."""
    df = _with_spans(docs, F.col(text))
    return df.withColumn("__spans", F.concat(*(_scored(k) for k in KINDS))).drop(*(f"__{k}" for k in KINDS))


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column pii: array<struct<kind, start, end, score>>, by kind as in KINDS, then start.

    Places are code points, end exclusive. A null text counts as empty and has no span; a match that its validator
    refuses gives none and is not tried again at another place. Spans of different kinds may overlap. Repeated rows and
    rows without an id are rows like others. Columns of docs stay, but for one named pii, which is replaced; names that
    start with two underscores are the operator's own and may not occur.
    """
    return _spans(docs.drop("pii"), text).withColumnRenamed("__spans", "pii").drop("__text", "__blocks")


def masked(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """docs with each span of a score of `least` or more replaced by <KIND>; overlapping spans by the first's.

    Null and empty texts stay as they are.
    """
    chosen = F.filter(F.col("__spans"), lambda s: s["score"] >= least)
    spans = F.array_sort(F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kind = "array<struct<start:int,end:int,kind:string>>"

    def join(acc: Column, s: Column) -> Column:
        """Regions so far, with a new one or the last one made longer."""
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & (s["start"] < F.when(F.size(acc) > 0, last["end"]).otherwise(F.lit(0)))
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer).cast(kind))).otherwise(F.concat(acc, F.array(s).cast(kind)))

    regions = F.col("__regions")

    def region(r: Column, k: Column) -> Column:
        before = F.when(k > 0, F.element_at(regions, F.greatest(k, F.lit(1)))["end"]).otherwise(F.lit(0))
        return F.concat(_piece(F.col("__blocks"), before, r["start"]), F.lit("<"), F.upper(r["kind"]), F.lit(">"))

    rest = _piece(F.col("__blocks"), F.element_at(regions, -1)["end"], F.length("__text"))
    df = _spans(docs, text).withColumn("__regions", F.aggregate(spans, F.array().cast(kind), join))
    out = F.when(F.size(regions) > 0, F.concat(F.array_join(F.transform(regions, region), ""), rest)).otherwise(F.col(text))
    return df.withColumn(text, out).drop("__text", "__blocks", "__spans", "__regions")


def _of(*kinds: str) -> Column:
    return F.filter("pii", lambda s: s["kind"].isin(*kinds))


def _joined(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(_of(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and places of pii_spans(), of every score; the scores are worked out, but its SQL has no column for them."""
    df = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return df.select("doc_id", *(F.size(_of(k)).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(BASE_KINDS), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))


def _sql_matches(kind: str, pattern: str, keep: str) -> str:
    """DuckDB: lists of 'kind:start:end' of the matches that pass `keep` (of the match m)."""
    return f"""
{kind}_raw AS (SELECT doc_id, x, regexp_extract_all(x, '{pattern}') AS ms, regexp_split_to_array(x, '{pattern}') AS gs FROM t),
{kind}_pos AS (SELECT doc_id, list_transform(range(1, len(ms) + 1), lambda i: struct_pack(m := ms[i], s := list_sum(list_transform(gs[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g)))::BIGINT, 0))) AS ps FROM {kind}_raw),
{kind} AS (SELECT doc_id, list_transform(list_filter(ps, lambda p: {keep}), lambda p: '{kind}:' || p.s || ':' || (p.s + length(p.m))) AS found FROM {kind}_pos)"""


_DIGITS = "regexp_replace(p.m, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i, 1)::INT
  WHEN substr({_DIGITS}, i, 1)::INT > 4 THEN substr({_DIGITS}, i, 1)::INT * 2 - 9 ELSE substr({_DIGITS}, i, 1)::INT * 2 END)) % 10 = 0"""
_MOD97 = """regexp_full_match(p.m, '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(p.m, 5) || substr(p.m, 1, 4), ''), lambda c:
  CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE (ascii(c) - 55)::BIGINT END)), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"""

OP6_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),"
    + ",".join([
        _sql_matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_matches("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(p.m, '.'), lambda d: d::HUGEINT <= 255))"),
        _sql_matches("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        _sql_matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        _sql_matches("iban", r"[A-Za-z0-9]+", _MOD97),
    ])
    + """
SELECT doc_id, len(email.found) AS n_email, len(ip.found) AS n_ip, len(card.found) AS n_card, len(phone.found) AS n_phone, len(iban.found) AS n_iban,
  sha256(array_to_string(email.found || ip.found || card.found || phone.found, ',')) AS base_sha256,
  array_to_string(email.found || ip.found || card.found || phone.found || iban.found, ',') AS spans
FROM email JOIN ip USING (doc_id) JOIN card USING (doc_id) JOIN phone USING (doc_id) JOIN iban USING (doc_id)"""
)
