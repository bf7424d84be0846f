"""Personal data in texts with DataFrame expressions alone (operator 8).

A regular expression proposes matches of a kind, a check confirms each (parts of an address, Luhn, digits of a phone number, mod-97),
and words shortly before a match raise its score. Kinds of ``BASE`` stay whatever their score; the kinds of ``EXTRA`` need
``THRESHOLD``. Patterns are written so that Java's matcher runs through any text in linear time and without recursion: possessive
loops, and starts only where a run of characters starts or the last match ended.

Splitting a text by the pattern gives the pieces between the matches, so positions are running sums of lengths and
nothing is looked up in the text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import documents as docs

CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.4
THRESHOLD = 0.5
_CHUNK = 256
_ADDRESS = r"[A-Za-z0-9._%+-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # what a text without a match rarely has, tested first
    score: float
    context: str  # words that make a match likelier

    def confirms(self, match: Column) -> Column:
        return _CHECKS[self.name](match)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; inside a lambda a plain column expression is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _luhn(match: Column) -> Column:
    def of(digits: Column) -> Column:
        def term(i: Column) -> Column:
            d = F.substr(digits, i, F.lit(1)).cast("int")
            twice = d * 2
            return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + term(i))
        return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)

    return _let(F.reverse(_digits(match)), of)


def _mod97(match: Column) -> Column:
    def of(compact: Column) -> Column:
        def step(rest: Column, i: Column) -> Column:
            c = F.ascii(F.substr(compact, i, F.lit(1)))
            return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

        # the country code and check digits come last
        order = F.concat(F.sequence(F.lit(5), F.length(compact)), F.sequence(F.lit(1), F.lit(4)))
        return F.when(F.length(compact).between(15, 34), F.aggregate(order, F.lit(0), step) == 1).otherwise(False)

    return _let(F.replace(match, F.lit(" "), F.lit("")), of)


_CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": _mod97,
    "ssn": lambda m: ~m.rlike(r"^(?:000|666|9..)-|-00-|-0000$"),
}

BASE = [
    Kind("email", rf"(?:\G|(?<!{_ADDRESS})){_ADDRESS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"e-?mail|mail|correo|courriel|kontakt|contact|address"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", 0.7, r"card|karte|carte|tarjeta|visa|master|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"tel|phone|mobile|call|fax|handy|anruf|appel|llam"),
]
EXTRA = [
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, r"iban|konto|account|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-", 0.3, r"\bssn\b|social security|social-security"),
]


def running_sums(lengths: Column) -> Column:
    """Sums of an array of bigints up to and with each element, by chunks so that long arrays don't cost their square."""

    def of_chunk(chunk: Column, before: Column) -> Column:
        return F.transform(chunk, lambda _, i: before + _sum(F.slice(chunk, F.lit(1), i + 1)))

    def of_chunks(chunks: Column, totals: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda chunk, k: _let(_sum(F.slice(totals, F.lit(1), k)), lambda before: of_chunk(chunk, before))))

    def of_all(values: Column) -> Column:
        last = (F.greatest(F.size(values) - 1, F.lit(0)) / _CHUNK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * _CHUNK + 1, F.lit(_CHUNK)))
        return _let(cut, lambda chunks: _let(F.transform(chunks, _sum), lambda totals: of_chunks(chunks, totals)))

    return _let(lengths, of_all)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"


def _matched(df: DataFrame, text: str, kind: Kind, found: str, pieces: str) -> DataFrame:
    """Two columns: the matches of a kind, and the pieces of text around them (null where there is no match)."""
    matches = F.when(F.col(text).rlike(kind.hint), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    df = df.withColumn(found, F.coalesce(matches, F.array().cast("array<string>")))
    return df.withColumn(pieces, F.when(F.size(found) > 0, F.split(text, kind.pattern, -1)))


def _spans(kind: Kind, rank: int, found: str, pieces: str) -> Column:
    def of(found: Column, pieces: Column, lengths: Column, ends: Column) -> Column:
        def span(match: Column, i: Column) -> Column:
            near = F.lower(F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS))).rlike(kind.context)
            score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0))
            return F.struct(
                (F.get(ends, i) - F.get(lengths, i)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), F.get(ends, i).alias("end"),
                F.when(kind.confirms(match), score).alias("score"),
            )

        least = THRESHOLD if kind in EXTRA else 0.0
        return F.filter(F.transform(found, span), lambda s: s["score"] >= least)  # an unconfirmed match has no score

    def with_ends(found: Column, pieces: Column, lengths: Column) -> Column:
        # a match ends where the pieces and matches up to it end
        ends = running_sums(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), lengths, lambda p, n: F.length(p) + n))
        return _let(ends, lambda e: of(found, pieces, lengths, e))

    matches, around = F.col(found), F.col(pieces)
    lengths = F.transform(matches, lambda m: F.length(m).cast("bigint"))
    made = _let(matches, lambda f: _let(around, lambda p: _let(lengths, lambda n: with_ends(f, p, n))))
    return F.when(F.size(matches) > 0, made).otherwise(F.array().cast(SPAN))


def _free(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name in taken:
        name += "_"
    return name


def find(df: DataFrame, text: str = "text", out: str = "spans", kinds: list[Kind] | None = None) -> DataFrame:
    """All columns of ``df`` and an array of spans (start, rank, kind, end, score) by start, then kind.

    Positions are code points, ends exclusive. Null and empty texts have no spans. Rows are judged each by itself. Columns
    with names of their own are never touched, ``out`` apart.
    """
    kinds = BASE + EXTRA if kinds is None else kinds
    columns = [c for c in df.columns if c != out]
    own = {k.name: [_free(f"__{part}_{k.name}", df.columns) for part in ("found", "pieces", "spans")] for k in kinds}
    made = df
    for kind in kinds:
        made = _matched(made, text, kind, *own[kind.name][:2])
    for rank, kind in enumerate(kinds):
        made = made.withColumn(own[kind.name][2], _spans(kind, rank, *own[kind.name][:2]))
    return made.select(*columns, F.array_sort(F.concat(*[F.col(own[k.name][2]) for k in kinds])).alias(out))


def redact(df: DataFrame, text: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """All columns of ``df``; in the text each confirmed match is replaced by its kind in brackets, kind after kind.

    A null text stays null. No bracketed word can be matched again.
    """
    columns = df.columns
    found, pieces = _free("__found", columns), _free("__pieces", columns)
    for kind in BASE + EXTRA if kinds is None else kinds:
        # a projection of its own for each kind; the next one reads what it made
        df = _matched(df, text, kind, found, pieces)

        joined = F.array_join(F.zip_with(F.col(pieces), F.col(found), _shown(kind)), "")
        df = df.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(F.col(text))).drop(found, pieces)
    return df.select(*columns)


def _shown(kind: Kind):
    """A piece and the match after it, the match in brackets where it is confirmed; the last piece has none."""

    def one(piece: Column, match: Column) -> Column:
        sure = kind.confirms(match)
        if kind in EXTRA:
            near = F.lower(F.right(piece, F.lit(CONTEXT_CHARS))).rlike(kind.context)
            sure = sure & (F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0) >= THRESHOLD)
        return F.concat(piece, F.when(match.isNull(), "").when(sure, f"[{kind.name.upper()}]").otherwise(match))

    return one


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: str, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def op8(spark: SparkSession, path: str) -> DataFrame:
    found = find(docs.texts(docs.table(spark, path, "documents")))
    base = [k.name for k in BASE]
    return found.select(
        "doc_id",
        *[F.size(_of("spans", [k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_listed(_of("spans", base)), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _sql_kind(name: str, rank: int, pattern: str, check: str) -> str:
    return f"""SELECT doc_id, {rank} AS rank, '{name}' AS kind, s.m AS m, s.e - len(s.m) AS start, s.e AS e FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 'e': list_sum(list_transform(p[1:i], lambda x: len(x))) + list_sum(list_transform(m[1:i], lambda x: len(x)))}})) AS s
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{pattern}')) AS a) AS b WHERE {check}"""


_SQL_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(s.m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "len(regexp_replace(s.m, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(regexp_replace(s.m, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(s.m, '[^0-9]', '', 'g'))[i] AS INT) ELSE (2 * CAST(reverse(regexp_replace(s.m, '[^0-9]', '', 'g'))[i] AS INT)) // 10 + (2 * CAST(reverse(regexp_replace(s.m, '[^0-9]', '', 'g'))[i] AS INT)) % 10 END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace(s.m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?\b", "CAST(array_to_string(list_transform(string_split(substr(replace(s.m, ' ', ''), 5) || substr(replace(s.m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS HUGEINT) % 97 = 1"),
]

OP8_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS (" + " UNION ALL ".join(_sql_kind(n, i, p, c) for i, (n, p, c) in enumerate(_SQL_KINDS)) + """),
per_doc AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(concat(kind, ':', start, ':', e), ',' ORDER BY start, rank) FILTER (rank < 4) AS base, string_agg(concat(kind, ':', start, ':', e), ',' ORDER BY start, rank) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (doc_id)"""

docs.register("op8_personal_data", op8, OP8_SQL)
