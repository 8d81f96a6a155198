"""Personal data in text: expressions propose spans, checksums confirm them, context words score them.

Only DataFrame functions run here. Every text is judged whole and row by row, so nothing is shuffled.

Defined results: a null or empty text has no spans; matches of one kind never overlap, those of
different kinds may; a match whose check fails is dropped and its characters are not searched again;
repeated rows give repeated results; other columns of the input pass through ``find_spans`` unchanged
unless they are called ``spans``, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.arrays import let, prefix_sums

# Repeats are possessive where nothing that follows could need the characters back, and a match that
# starts inside a run of its own characters is refused at once: same matches, linear time.
_IP_PART = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# A match counts from this score on.
ACCEPT = 0.6
# Characters before a match in which context words are looked for.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``base`` kinds count by pattern and check, whatever the score."""

    name: str
    pattern: str
    hint: str  # cheap condition that any text with a match fulfils
    context: str
    check: object = None
    base: bool = True
    prior: float = 0.5


def _digits(match: Column) -> Column:
    return F.translate(match, " ().+-", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of at most 19 digits."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return total % 10 == 0


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _ip(match: Column) -> Column:
    return match.rlike(rf"^0*{_IP_PART}(?:\.0*{_IP_PART}){{3}}$")


def mod97(match: Column) -> Column:
    """Account number check: country and check digits to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(
            c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97
        ).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(plain).between(15, 34) & (value == 1)


KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         r"\b(?:e-?mail|contact|write|courriel|correo)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"\b(?:ip|address|host|server|login)\b", _ip),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][ -]?[0-9]", r"\b(?:card|visa|credit|karte|carte|tarjeta)\b", _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"\b(?:phone|tel|call|mobile|fax)\b", _phone),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "[A-Z]{2}[0-9]{2}[ 0-9A-Z]{8}",
         r"\b(?:iban|account|konto|compte|cuenta)\b", mod97, base=False, prior=0.4),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]{4}",
         r"\b(?:ssn|social security|tax id|national id)\b", base=False, prior=0.4),
]


def _spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Accepted spans of one kind: ``start, rank, end, kind, score`` with code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")

    def spans(found: Column) -> Column:
        return let(F.split(text, kind.pattern, -1), lambda gaps: let(
            prefix_sums(F.transform(found, lambda m, i: F.length(m) + F.length(gaps[i]))),
            lambda ends: F.filter(F.transform(found, lambda m, i: span(m, gaps[i], ends[i])), lambda s: s["start"] >= 0),
        ))

    def span(match: Column, gap: Column, end: Column) -> Column:
        near = F.lower(F.right(gap, F.lit(CONTEXT))).rlike(kind.context)
        valid = kind.check(match) if kind.check else F.lit(True)
        score = F.least(F.lit(1.0), F.lit(kind.prior) + F.when(near, 0.3).otherwise(0.0) + (0.3 if kind.check else 0.0))
        keep = valid if kind.base else valid & (score >= ACCEPT)
        return F.struct(
            F.when(keep, end - F.length(match)).otherwise(-1).cast("int").alias("start"), F.lit(rank).alias("rank"),
            end.cast("int").alias("end"), F.lit(kind.name).alias("kind"), score.cast("double").alias("score"),
        )

    hinted = text.contains("@") if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hinted, let(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none)
    )).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", kinds: list[Kind] = KINDS) -> DataFrame:
    """Add ``spans``: an array of ``(start, rank, end, kind, score)`` by start, then kind as listed."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.concat(*[_spans_of(whole, k, i) for i, k in enumerate(kinds)])
    return docs.withColumn("spans", F.sort_array(found))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, the digest of the base spans, all spans and their scores x 1000."""
    base = [k.name for k in KINDS if k.base]

    def of_kind(name: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == name)

    return find_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 1000).cast("int").cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """Replace every span by its kind in angle brackets; spans that overlap become one mark."""
    marks = F.aggregate(
        F.col("_spans"),
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["parts"], F.array(
                F.substr(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            )).alias("parts"), s["end"].alias("at"),
        )).otherwise(F.struct(acc["parts"].alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(F.col("_text"), acc["at"] + 1)),
    )
    columns = docs.columns
    found = find_spans(docs.select(F.struct(*columns).alias("_row"), F.col("text").alias("_text")), "_text")
    found = found.withColumnRenamed("spans", "_spans").withColumn(
        "_new", F.when(F.size("_spans") > 0, marks).otherwise(F.col("_text"))
    )
    replaced = {"text": F.col("_new")}
    if "n_chars" in columns:
        replaced["n_chars"] = F.when(F.size("_spans") > 0, F.length("_new")).otherwise(F.col("_row.n_chars")).cast("bigint")
    return found.select(*[replaced.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])


def sql() -> str:
    """The same for DuckDB over the table ``documents``; a national id is a whole run of digits and hyphens."""
    finds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": KINDS[4].pattern, "national_id": r"[0-9-]+",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    plain = "replace(m, ' ', '')"
    luhn_sum = (
        f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN (len({digits}) - i) % 2 = 0 THEN {digits}[i]::INT "
        f"WHEN {digits}[i]::INT > 4 THEN 2 * {digits}[i]::INT - 9 ELSE 2 * {digits}[i]::INT END))"
    )
    moved = f"string_split({plain}[5:] || {plain}[1:4], '')"
    remainder = (
        f"list_reduce(list_prepend(0, list_transform({moved}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END)), "
        "lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97)"
    )
    valid = {
        "email": "true", "ip": f"regexp_full_match(m, '0*{_IP_PART}(?:\\.0*{_IP_PART}){{3}}')".replace("\\\\", "\\"),
        "card": f"len({digits}) BETWEEN 14 AND 19 AND {luhn_sum} % 10 = 0", "phone": f"len({digits}) BETWEEN 10 AND 15",
        "iban": f"len({plain}) BETWEEN 15 AND 34 AND {remainder} = 1", "national_id": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
    }
    parts = []
    for rank, kind in enumerate(KINDS):
        score = f"least(1.0, {kind.prior} + CASE WHEN regexp_matches(lower(right(gap, {CONTEXT})), '{kind.context}') THEN 0.3 ELSE 0.0 END + {0.3 if kind.check else 0.0})"
        keep = valid[kind.name] if kind.base else f"{valid[kind.name]} AND {score} >= {ACCEPT}"
        parts.append(f"""
SELECT r, e - len(m) AS s, {rank} AS rank, e, '{kind.name}' AS kind, {str(kind.base).lower()} AS base, round({score} * 1000)::INT AS score FROM (
  SELECT r, f[i] AS m, g[i] AS gap, list_sum(list_transform(range(1, i + 1), lambda j: len(f[j]) + len(g[j])))::BIGINT AS e FROM (
    SELECT r, f, g, unnest(range(1, len(f) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(text, '{finds[kind.name]}') AS f, string_split_regex(text, '{finds[kind.name]}') AS g FROM docs
    )
  )
) WHERE {keep}""")
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    one = "kind || ':' || s || ':' || e"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)})
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce(string_agg({one}, ',' ORDER BY s, rank) FILTER (WHERE base), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY s, rank), '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY s, rank), '') AS scores
FROM docs LEFT JOIN spans USING (r) GROUP BY r
""".strip()
