"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for account numbers, the range of
the parts for addresses), and context words within 40 characters before a span move its score. Java's regular
expressions give no positions, so each pattern both splits the text and extracts its matches; the lengths of the
pieces between matches and of the matches, summed from the left, are the positions (in code points).

The patterns begin at ``\\G`` (where the last match ended) or where a run of their characters begins, and repeat
possessively: the same matches as the plain patterns, but in time linear in the text.

An account number can be followed by a capitalised or upper-case word or a number, which its pattern takes along. So
only its first four signs are matched, and a lookahead takes the longest run after them; of the prefixes of this run
that end with a group, the longest that leaves 1 modulo 97 is the number (a following group of capitals or digits
belongs to it by chance once in 97). Numbers that begin within a confirmed one are dropped.

Kinds: email, ip, card, phone (the base ones) and iban (which the checksum adds). A match of a base kind that fails its
check is dropped and not tried again. Scores: email 0.9, ip 0.6, card 0.9, phone 0.5, iban 0.95, plus 0.1 where a context word
of the kind is near, at most 1. The score decides nothing here: base spans stay whatever their score.

Rows: null and empty texts have no spans; every input row gives one output row; whole texts are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
#: Linear forms of the stated patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[0-9 -](?<![ -](?![0-9])))++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
}
#: A cheap necessary condition for a match, so that most texts are not split at all.
_HINT = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"}
_SIGN = {"email": "@", "phone": "+", "ip": "."}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.5, "iban": 0.95}
CONTEXT = {"email": "mail|contact|write|kontakt|courriel|correo", "ip": "ip|address|host|server|adresse", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax|anruf|appel", "iban": "iban|account|bank|konto|compte|cuenta"}
REACH = 40
#: Matches whose positions are summed in one fold.
BLOCK = 256

_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """Whether the digits of c pass Luhn's check."""
    digits = F.reverse(F.split(_digits(c), ""))
    def value(x: Column, i: Column) -> Column:
        d = x.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)
    total = F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _mod97(c: Column) -> Column:
    """Whether the account number c leaves 1 modulo 97, its first four signs moved to the end and letters read as 10 to 35."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    def step(a: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _account(run: Column) -> Column:
    """The longest prefix of ``run`` that ends with a group and is a valid account number, or null. A run ends with the
    sign that rules its last group out, where there is one."""
    ends = F.filter(F.sequence(F.length(run), F.lit(15), F.lit(-1)), lambda n: (F.substring(run, n + 1, F.lit(1)).isin("", " ")) & F.regexp(F.substring(run, n, F.lit(1)), F.lit("[A-Z0-9]")))
    prefixes = F.transform(ends, lambda n: F.substring(run, F.lit(1), n))
    return F.get(F.filter(prefixes, lambda c: _valid("iban", c)), F.lit(0))


def _apart(spans: Column) -> Column:
    """The spans without those that begin within an earlier one that stays."""
    start = F.struct(F.lit(0).alias("at"), F.slice(spans, 1, 0).alias("out"))
    def step(a: Column, s: Column) -> Column:
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(s)).alias("out")))
    return F.aggregate(spans, start, step)["out"]


def _valid(kind: str, c: Column) -> Column:
    n = F.length(_digits(c))
    if kind == "ip":
        return F.forall(F.split(c, r"\."), lambda p: F.regexp(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(c)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(c, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(c)
    return F.lit(True)


def hint(kind: str, text: Column, digit: Column | None = None) -> Column:
    """Whether the text can hold a span of the kind; digit: whether it holds a digit, if that is known."""
    digit = F.regexp(text, F.lit("[0-9]")) if digit is None else digit
    parts = [F.contains(text, F.lit(_SIGN[kind]))] if kind in _SIGN else []
    parts += [digit] if kind != "email" else []
    parts += [F.regexp(text, F.lit(_HINT[kind]))] if kind in _HINT else []
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = F.when(p, out).otherwise(False)
    return out


def _kind_spans(kind: str, text: Column, digit: Column | None = None) -> Column:
    """The confirmed spans of one kind, in order."""
    gaps, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    lengths = F.filter(lengths, lambda x: x["match"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))
    def place(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)["out"]
    # Positions are summed block by block: appending to one array would copy it for every match.
    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, BLOCK))
    def begins(x: Column) -> Column:
        size = lambda y: F.aggregate(y, F.lit(0), lambda a, m: a + m["gap"] + F.length(m["match"]))
        return F.aggregate(x, F.array(F.lit(0)), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + size(y))))
    matches = F.flatten(F.transform(F.array(blocks(lengths)), lambda x: F.flatten(F.zip_with(x, F.slice(begins(x), 1, F.size(x)), place))))
    if kind == "iban":
        runs = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))
        whole = F.zip_with(matches, runs, lambda s, run: F.struct(s["start"].alias("start"), _account(F.concat(s["match"], run)).alias("match")))
        whole = F.filter(whole, lambda s: s["match"].isNotNull())
        placed = _apart(F.transform(whole, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("match"))))
    else:
        placed = F.filter(matches, lambda s: _valid(kind, s["match"]))
    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - REACH, F.lit(0))
        near = F.lower(F.substring(text, first + 1, s["start"] - first))
        lift = F.when(F.regexp(near, F.lit(rf"(?:^|[^a-z0-9])(?:{CONTEXT[kind]})")), 0.1).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), F.lit(SCORE[kind]) + lift).alias("score"))
    return F.when(hint(kind, text, digit), F.transform(placed, scored)).otherwise(F.array().cast(_SPAN))


def with_spans(df: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """``df`` and, for each kind, the column prefix + kind: array of (kind, start, end, score)."""
    text, digit = F.coalesce(F.col(text_col), F.lit("")), F.col(f"{prefix}digit")
    found = df.withColumn(f"{prefix}digit", F.regexp(text, F.lit("[0-9]")))
    return found.withColumns({f"{prefix}{k}": _kind_spans(k, text, digit) for k in KINDS}).drop(f"{prefix}digit")


def _joined(columns: list[Column]) -> Column:
    every = F.concat(*columns)
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, counts of the base kinds, the hash of the base spans, all spans, and their scores."""
    found = with_spans(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", "k_")
    spans = {k: F.col(f"k_{k}") for k in KINDS}
    return found.select(
        F.col("id").alias(id_col),
        *(F.size(spans[k]).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined([spans[k] for k in BASE]), 256).alias("base_sha256"),
        _joined(list(spans.values())).alias("spans"),
        F.array_join(F.transform(F.concat(*spans.values()), lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by its kind in brackets; overlapping spans merge into the first
    (the longer of two that begin together), null texts stay null; other columns stay, whatever their names."""
    columns, own = df.columns, "_pii_"
    while any(c.startswith(own) for c in columns):
        own = "_" + own
    found = with_spans(df, text_col, own)
    spans = F.array_sort(F.concat(*(F.col(f"{own}{k}") for k in KINDS)), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    done = F.aggregate(F.col(f"{own}spans"), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    found = found.withColumn(f"{own}spans", spans)
    return found.withColumn(text_col, F.when(F.size(f"{own}spans") > 0, done).otherwise(text)).select(*columns)


def _sql() -> str:
    """The same in DuckDB's SQL: positions from the lengths of the pieces between matches and of the matches. Its
    regular expressions have no lookaround, so an account number takes the sign before it along, and what follows is
    looked at afterwards."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    moved = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
    valid = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda p: try_cast(p AS HUGEINT) IS NULL OR try_cast(p AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({digits}, CAST(length({digits}) - i AS INTEGER), 1) AS INTEGER) ELSE CAST(substr({digits}, CAST(length({digits}) - i AS INTEGER), 1) AS INTEGER) * 2 - CASE WHEN CAST(substr({digits}, CAST(length({digits}) - i AS INTEGER), 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"NOT regexp_matches(substr(text, CAST(b + length(m) + 1 AS INTEGER), 1), '[A-Za-z0-9]') AND length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({moved}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: CASE WHEN x < 58 THEN (a * 10 + x - 48) % 97 ELSE (a * 100 + x - 55) % 97 END, CAST(0 AS BIGINT)) = 1",
    }
    parts = []
    for n, k in enumerate(KINDS):
        skip = "CASE WHEN regexp_matches(m0, '^[A-Z]{2}[0-9]{2}') THEN 0 ELSE 1 END" if k == "iban" else "0"
        parts.append(
            f"{k}0 AS (SELECT doc_id, r, text, string_split_regex(text, '{plain[k]}') AS g, regexp_extract_all(text, '{plain[k]}') AS x FROM d WHERE regexp_matches(text, '{plain[k]}')),"
            f" {k}1 AS (SELECT doc_id, r, text, x[i] AS m0, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(x[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS b0 FROM {k}0, unnest(range(1, len(x) + 1)) AS u(i)),"
            f" {k}2 AS (SELECT doc_id, r, text, substr(m0, 1 + {skip}) AS m, b0 + {skip} AS b FROM {k}1),"
            f" {k} AS (SELECT doc_id, r, {n} AS n, '{k}' AS kind, b, b + length(m) AS e, least(1.0, {SCORE[k]} + CASE WHEN regexp_matches(lower(substr(text, CAST(greatest(b - {REACH}, 0) + 1 AS INTEGER), CAST(b - greatest(b - {REACH}, 0) AS INTEGER))), '(?:^|[^a-z0-9])(?:{CONTEXT[k]})') THEN 0.1 ELSE 0 END) AS score FROM {k}2 WHERE {valid[k]})"
        )
    every = " UNION ALL ".join(f"SELECT * FROM {k}" for k in KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    span = "kind || ':' || b || ':' || e"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents), {', '.join(parts)}, s AS ({every}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY n, b) FILTER (WHERE n < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY n, b), '') AS spans,"
        " coalesce(string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY n, b), '') AS scores FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.doc_id, d.r"
    )


SQL = _sql()
