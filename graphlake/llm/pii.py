"""Personal data and secrets in texts, with DataFrame expressions only.

Regular expressions propose spans, checksums (Luhn, mod-97) and plain tests confirm them, and context words near a
span adjust its score. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: The base patterns as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time and constant stack: a run is entered only at its start or where the match before
#: ended, and is never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words that raise a span's score, and words that lower it, when they stand within WINDOW characters before it, behind
#: the match before.
CONTEXT = {
    "email": ("mail|e-mail|contact|write", "example"),
    "ip": ("ip|host|server|address", "version|release"),
    "card": ("card|visa|credit|pay|payment", "order|invoice|isbn"),
    "phone": ("phone|tel|call|mobile|fax", "order|invoice|isbn"),
    "iban": ("iban|account|bank|konto", "order|invoice|isbn"),
    "ssn": ("ssn|social|security", "order|invoice|part|isbn"),
    "tel": ("phone|tel|call|mobile|fax|telefon|tfno|ring", "order|invoice|part|isbn"),
    "key": ("key|token|secret|auth|bearer", "example|sample"),
    "secret": ("api|auth|bearer|credential|private|login", "example|sample"),
}
WINDOW, BONUS, PENALTY = 40, 30, 30
#: Scores without context, in hundredths.
SCORES = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 80, "ssn": 30, "tel": 30, "key": 80, "secret": 60}
#: Added kinds need this score, base kinds none.
LEAST = 50


@dataclass(frozen=True)
class Added:
    """A kind of the method's own. Its pattern takes the character before the span along and runs on to the end of the
    characters that could belong to it; `core` is the span inside the match, up to its end, and `whole` what it must be."""

    pattern: str
    core: str
    whole: str
    #: Further tests of the span: in Spark (as x.c) and in DuckDB (as c).
    test: str = "true"
    sql: str = "true"
    #: A text without this holds no span of the kind.
    hint: str = "true"


_IBAN = "concat(substr(replace({0}, ' ', ''), 5), substr(replace({0}, ' ', ''), 1, 4))"
_KEYS = "(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20}|xox[abprs]-[A-Za-z0-9]{10}|AIza[A-Za-z0-9_]{35}|eyJ[A-Za-z0-9_]{20})"
_NAMES = "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Kk]ey|KEY)"
ADDED = {
    "iban": Added(
        r"[^A-Za-z0-9][A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?[A-Za-z0-9]*",
        r"[A-Za-z0-9][A-Za-z0-9\x20]*$",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        # mod-97: letters count as 10 to 35, the first four characters go last
        f"aggregate(split({_IBAN.format('x.c')}, ''), 0, (r, d) -> (r * if(d <= '9', 10, 100) + ascii(d) - if(d <= '9', 48, 55)) % 97) = 1",
        f"list_reduce(list_prepend(0, list_transform(string_split({_IBAN.format('c')}, ''), lambda d: ascii(d) - CASE WHEN d <= '9' THEN 48 ELSE 55 END)), lambda r, n: (r * CASE WHEN n < 10 THEN 10 ELSE 100 END + n) % 97) = 1",
    ),
    "ssn": Added(
        r"[^A-Za-z0-9-][0-9]{3}-[0-9]{2}-[0-9]{4}[A-Za-z0-9-]*",
        r"[0-9][A-Za-z0-9-]*$",
        r"(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:[0-9]{3}[1-9]|[0-9]{2}[1-9]0|[0-9][1-9]00|[1-9]000)",
        hint="contains(text, '-')",
    ),
    "tel": Added(
        r"[^A-Za-z0-9+.-]\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,5}[A-Za-z0-9.-]*",
        r"\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,5}[A-Za-z0-9.-]*$",
        r"\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,5}\.?",
    ),
    "key": Added(rf"[^A-Za-z0-9_-]{_KEYS}[A-Za-z0-9_.-]*", r"[A-Za-z0-9_-][A-Za-z0-9_.-]*$", rf"{_KEYS}[A-Za-z0-9_.-]*"),
    "secret": Added(
        rf"{_NAMES}[\x22']?[\x20\t]{{0,3}}[:=]{{1,2}}[\x20\t]{{0,3}}[\x22']?[A-Za-z0-9_+/.-]{{12,}}={{0,2}}",
        r"[A-Za-z0-9_+/.-]+={0,2}$",
        r"[A-Za-z0-9_+/.-]+={0,2}",
        "x.c rlike '[0-9]' and x.c rlike '[A-Za-z]' and size(array_distinct(split(x.c, ''))) >= 8",
        "regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Za-z]') AND len(list_distinct(string_split(c, ''))) >= 8",
        hint="(contains(text, '=') or contains(text, ':'))",
    ),
}
KINDS = (*BASE, *ADDED)
HINTS = {"email": "contains(text, '@')", "phone": "contains(text, '+')"} | {k: a.hint for k, a in ADDED.items()}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_DIGITS = "regexp_replace(x.c, '[^0-9]', '')"
#: Tests of a span x.c.
CHECKS = {
    "email": "true",
    "ip": rf"x.c rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
    "card": f"length(x.c) >= 14 and length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 10 and 15",
} | {k: f"x.c rlike r\"^(?:{a.whole})$\" and {a.test}" for k, a in ADDED.items()}


def _words(words: str) -> str:
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def _walk(kind: str) -> str:
    """Walks over the (piece, match) pairs of a kind and gathers its confirmed spans; the last piece has no match.

    Added kinds are looked for behind a space put before the text, so their places are one less.
    """
    added = ADDED.get(kind)
    core = f'regexp_extract(m, r"{added.core}", 0)' if added else "m"
    end = f"a.pos + length(x.p) + length(x.m){' - 1' if added else ''}"
    near = f"lower(right(x.p, {WINDOW}))"
    good, bad = (f"{near} rlike r'{_words(w)}'" for w in CONTEXT[kind])
    score = f"least(100, greatest(0, {SCORES[kind]} + if({good}, {BONUS}, 0) - if({bad}, {PENALTY}, 0)))"
    span = f"named_struct('begin', {end} - length(x.c), 'rank', {KINDS.index(kind)}, 'end', {end}, 'kind', '{kind}', 'score', {score} / 100.0d)"
    keep = f"{CHECKS[kind]} and {score} >= {LEAST}" if added else CHECKS[kind]
    return (
        f"aggregate(zip_with(split_{kind}, found_{kind}, (p, m) -> named_struct('p', p, 'm', m, 'c', {core})), "
        "named_struct('pos', 0L, 'spans', cast(array() as array<struct<begin: bigint, rank: int, end: bigint, kind: string, score: double>>)), "
        f"(a, x) -> named_struct('pos', a.pos + length(x.p) + length(x.m), 'spans', if(x.m is not null and {keep}, array_append(a.spans, {span}), a.spans)), a -> a.spans)"
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and `found`: array of (begin, rank, end, kind, score), by begin and then by kind as in KINDS.

    Reads `doc_id` and `text` alone, so columns of any name may stand beside them. A null text counts as empty and has
    no spans; texts of any length are searched whole, in linear time; repeated rows give repeated results; an empty table
    gives none. Null doc_ids are passed on. Spans of different kinds may overlap, and of those with the same begin the
    kind that stands first in KINDS comes first.
    """
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("padded", F.concat(F.lit(" "), "text"))
    empty = F.array().cast("array<string>")
    where = {kind: "padded" if kind in ADDED else "text" for kind in KINDS}
    patterns = PATTERNS | {k: a.pattern for k, a in ADDED.items()}
    for kind in KINDS:
        found = F.regexp_extract_all(where[kind], F.lit(patterns[kind]), F.lit(0))
        if HINTS.get(kind, "true") != "true":
            found = F.when(F.expr(HINTS[kind]), found).otherwise(empty)
        out = out.withColumn(f"found_{kind}", found)
    for kind in KINDS:
        out = out.withColumn(f"split_{kind}", F.when(F.size(f"found_{kind}") > 0, F.split(where[kind], patterns[kind], -1)).otherwise(empty))
    spans = F.array_sort(F.concat(*(F.expr(_walk(kind)) for kind in KINDS)))
    return out.select("doc_id", spans.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the base spans' hash, all spans as text, and their scores in hundredths.

    Reads doc_id and found; a row for each row, whatever its doc_id. A text without spans has zeros and empty texts.
    """
    text = "concat_ws(':', s.kind, cast(s.begin as string), cast(s.end as string))"
    base = f"concat_ws(',', transform(filter(found, s -> s.rank < {len(BASE)}), s -> {text}))"
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.size("found").cast("bigint").alias("n_found"),
        F.sha2(F.expr(base), 256).alias("base_sha256"),
        F.expr(f"concat_ws(',', transform(found, s -> {text}))").alias("spans"),
        F.expr("concat_ws(',', transform(found, s -> cast(cast(round(s.score * 100) as int) as string)))").alias("scores"),
    )


def _oracle() -> str:
    """The same for DuckDB, from the plain patterns."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
    digits = "regexp_replace(c, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST(substr({digits}, i, 1) AS INT) ELSE (CAST(substr({digits}, i, 1) AS INT) * 2) % 10 + (CAST(substr({digits}, i, 1) AS INT) * 2) // 10 END)) % 10 = 0"
    tests = {
        "email": "true",
        "ip": rf"regexp_full_match(c, '{octet}\.{octet}\.{octet}\.{octet}')",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rank, kind in enumerate(KINDS):
        added = ADDED.get(kind)
        pattern = quoted(added.pattern if added else PLAIN[kind].replace("(", "(?:"))
        text, back = ("' ' || text", 1) if added else ("text", 0)
        good, bad = (f"regexp_matches(lower(right(p[i], {WINDOW})), {quoted(_words(w))})" for w in CONTEXT[kind])
        test = f"regexp_full_match(c, {quoted(added.whole)}) AND {added.sql} AND score >= {LEAST}" if added else tests[kind]
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS k, e - length(c) AS b, e, score FROM (SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) - {back} AS BIGINT) AS e, "
            f"{f'regexp_extract(m, {quoted(added.core)})' if added else 'm'} AS c, least(100, greatest(0, {SCORES[kind]} + CASE WHEN {good} THEN {BONUS} ELSE 0 END - CASE WHEN {bad} THEN {PENALTY} ELSE 0 END)) AS score "
            f"FROM (SELECT doc_id, p, ms, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, string_split_regex({text}, {pattern}) AS p, regexp_extract_all({text}, {pattern}) AS ms FROM d))) WHERE {test}"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in KINDS)
    span = "kind || ':' || b || ':' || e"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)}), g AS (SELECT doc_id, {counts}, count(*) AS n_found, string_agg({span}, ',' ORDER BY b, k) FILTER (k < {len(BASE)}) AS base, string_agg({span}, ',' ORDER BY b, k) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY b, k) AS scores FROM s GROUP BY doc_id) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in (*KINDS, 'found'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g ON d.doc_id = g.doc_id"
    )


ORACLE_SQL = _oracle()
