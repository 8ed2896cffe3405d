"""Personal data: regular expressions propose spans, checksums confirm them, context words move their score.

Base kinds are email, ip, card (Luhn) and phone; they stay whatever their score. Added kinds need a score of at least
`MIN_SCORE`: iban (its country's length, mod 97), national_id (a number that only context words make personal) and secret: the value
after a credential's name, quoted or up to the next blank or quote; what follows `Bearer`; keys of known shapes; and blocks of
private keys. A named value that looks like a plain word, by its kinds of characters and bits a character, needs context words.
Spans are code points, the end is exclusive.

The expressions are written so that Java's matcher needs neither deep recursion nor repeated scans: quantified groups are
possessive, and a match may begin only where a run of its characters begins. That changes no match. Positions are summed
up within blocks of matches and over blocks, and pieces of a text are cut from chunks of it, so that the time grows with
the text's length and its spans, not with their product (an accumulator of `aggregate` is copied at every step).

Defined cases: a null text is empty and has no span; an empty table gives no rows; a very long text is searched whole; repeated rows get equal results; extra columns pass through and one
named like a result is replaced. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _java(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "secret")
MIN_SCORE = 0.5
CONTEXT_CHARS = 48
#: Code points of a chunk of a text, matches in a block.
CHUNK = 4096
BLOCK = 128
#: Characters of an IBAN by country, fixed values of the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_LENGTH = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_KNOWN_IBAN = f"(?:{_BY_LENGTH})(?![A-Za-z0-9])"
#: A credential's name, what stands between it and its value, and the value: quoted, or up to the next blank or quote, without
#: the punctuation at its end.
_NAMES = r"token|secret|password|passwd|pwd|passphrase|credentials?|(?:api|access|private|account|client|auth|signing|encryption)[_-]?key"
_NAMED = rf"(?<![A-Za-z0-9_-])(?i:[A-Za-z0-9_-]{{0,40}}?(?:{_NAMES})(?:[_-][a-z0-9]{{1,20}}){{0,3}}+)[\x22\x27]?\x20?(?:=>|:=|[=:])\x20?(?:\x22[^\x22\n]{{4,}}+\x22?|\x27[^\x27\n]{{4,}}+\x27?|(?=[^\s\x22\x27<>]{{6}})[^\s\x22\x27<>.,;:!?)]*+(?:[.,;:!?)]++[^\s\x22\x27<>.,;:!?)]++)*+)"
_BEARER = r"(?<![A-Za-z0-9_-])(?i:authorization[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?(?:bearer|basic|token)|bearer)\x20[A-Za-z0-9._~+/=-]{8,}+"
#: Keys that tell themselves: prefixes that services give theirs, fixed values, and three dotted parts of a signed token.
SHAPES = ("(?:AKIA|ASIA|AIDA|AROA)[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36,}+", "github_pat_[A-Za-z0-9_]{22,}+", "glpat-[A-Za-z0-9_-]{20,}+", "xox[abposr]-[A-Za-z0-9-]{10,}+", "AIza[0-9A-Za-z_-]{35}", "[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+", "npm_[A-Za-z0-9]{36}", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_SHAPES = rf"(?<![A-Za-z0-9_-])(?:{'|'.join(SHAPES)})(?![A-Za-z0-9_])"
#: A block of a private key; one that is cut off ends where its lines do.
_KEY_BLOCK = r"-----BEGIN\x20(?:(?!PRIVATE)[A-Z0-9]++\x20)*+PRIVATE\x20KEY-----(?:[A-Za-z0-9+/=,:\s]++|-(?!----))*+(?:-----END\x20[A-Z0-9\x20]{0,40}+-----)?+"
#: What proposes a span of each kind. An IBAN has its country's length; where none fits, all that may follow is proposed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_KNOWN_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_KNOWN_IBAN}))?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": rf"(?:{_NAMED}|{_BEARER}|{_SHAPES}|{_KEY_BLOCK})",
}
_SECRET_NEEDS = (
    r"(?i:token|secret|passw|pwd|passphrase|credential|key)[A-Za-z0-9_-]*+[\x22\x27]?\x20?[=:]|(?i:bearer\x20|authorization)|AKIA|ASIA|AIDA|AROA|gh[pousr]_|github_pat_|glpat-|xox[abposr]-|AIza|k_live_|k_test_|npm_|eyJ|PRIVATE\x20KEY"
)
#: A character or string without which a kind cannot occur, and is not looked for.
NEEDS = {"email": "text LIKE '%@%'", "ip": "text RLIKE '[0-9]'", "card": "text RLIKE '[0-9]'", "phone": "text LIKE '%+%'", "iban": "text RLIKE '[A-Z]{2}[0-9]{2}'", "national_id": "text RLIKE '[0-9]-[0-9]{2}-[0-9]'", "secret": "text RLIKE " + _java(_SECRET_NEEDS)}
#: Score of a proposed span, and what a nearby word of the kind adds.
SCORES = {"email": (0.9, 0.1), "ip": (0.7, 0.2), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.8, 0.2), "national_id": (0.3, 0.5), "secret": (0.7, 0.2)}
#: A named value that may be a plain word scores less. It is none if it has a digit and LONG_SECRET characters; two classes of
#: characters (a capital at its beginning is none) and SOME_BITS a character; or RICH_BITS a character at LONG_PLAIN characters.
PLAIN_SECRET, LONG_SECRET, LONG_PLAIN, SOME_BITS, RICH_BITS = 0.35, 16, 20, 2.5, 3.5
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|host|server|address|login", "card": "card|visa|credit|payment|pay", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer", "national_id": "ssn|social|security|identity|passport", "secret": "key|auth|login|access|credential",
}


def _kept(sql: str) -> Column:
    """The expression, so that the optimiser neither inlines it nor pushes a filter through it: filters on results would
    else be rewritten into expressions that grow with every step."""
    return F.expr(f"if(monotonically_increasing_id() >= 0, {sql}, NULL)")


def _gaps(kind: str) -> str:
    """SQL: array of (gap, m), what lies before each match and the match; the last gap has none."""
    p = _java(PATTERNS[kind])
    zipped = f"zip_with(transform(split(text, {p}, -1), g -> length(g)), regexp_extract_all(text, {p}, 0), (g, m) -> struct(g AS gap, m AS m))"
    return f"CASE WHEN {NEEDS[kind]} THEN {zipped} ELSE cast(array() AS array<struct<gap:int,m:string>>) END"


def _blocks(array: str, block: str) -> str:
    """SQL: `block` for each block `b` of an array, where `c` is its number."""
    return f"transform(sequence(0, size({array}) div {BLOCK}), c -> {block.format(b=f'slice({array}, c * {BLOCK} + 1, {BLOCK})')})"


def _before(array: str, seed: str, value: str, joined: str) -> str:
    """SQL: what comes before each block: `value` of its elements x, put together by `joined` of {0} and {1}."""
    own = _blocks(array, f"aggregate({{b}}, {seed}, (s, x) -> {joined.format('s', value)})")
    return f"aggregate({own}, array({seed}), (a, t) -> concat(a, array({joined.format('element_at(a, -1)', 't')})))"


def _proposed(kind: str) -> str:
    """SQL: array of (start, end, m), from the columns gaps_ and before_ of the kind."""
    spans = "array<struct<start:int,end:int,m:string>>"
    entry = "struct(a.pos + x.gap AS start, a.pos + x.gap + length(x.m) AS end, x.m AS m)"
    step = f"if(x.m IS NULL, a, struct(a.pos + x.gap + length(x.m) AS pos, concat(a.cur, array({entry})) AS cur))"
    block = f"aggregate({{b}}, struct(before_{kind}[c] AS pos, cast(array() AS {spans}) AS cur), (a, x) -> {step}, a -> a.cur)"
    return f"CASE WHEN size(gaps_{kind}) > 1 THEN flatten({_blocks(f'gaps_{kind}', block)}) ELSE cast(array() AS {spans}) END"


#: SQL: the text's chunks.
_CHUNKS = f"transform(sequence(0, length({{0}}) div {CHUNK}), i -> substring({{0}}, i * {CHUNK} + 1, {CHUNK}))"


def _piece(start: str, end: str) -> str:
    """SQL: the code points start to end - 1 of the text, from `chunks`."""
    own = f"greatest({start} - k * {CHUNK}, 0)"
    return f"if(({end}) <= ({start}), '', array_join(transform(sequence(cast(({start}) div {CHUNK} AS int), cast((({end}) - 1) div {CHUNK} AS int)), k -> substring(chunks[k], {own} + 1, least({end} - k * {CHUNK}, {CHUNK}) - {own})), ''))"


def _luhn(digits: str) -> str:
    digit = f"cast(substring(reverse({digits}), i, 1) AS int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))) % 10 = 0"


def _candidates(kind: str) -> str:
    """SQL: the proposed spans; those of an IBAN of no known country end with the longest of their words that confirms it."""
    if kind != "iban":
        return f"found_{kind}"
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    ends = "filter(sequence(length(y.m), 15, -1), n -> substring(y.m, n + 1, 1) IN ('', ' ') AND substring(y.m, n, 1) <> ' ')"
    cut = "struct(y.start AS start, y.start + n AS end, substring(y.m, 1, n) AS m)"
    shorter = f"slice(filter(transform({ends}, n -> {cut}), x -> {_confirmed(kind)}), 1, 1)"
    return f"flatten(transform(found_{kind}, y -> if(y.m RLIKE '^({known})', array(y), {shorter})))"


def _confirmed(kind: str) -> str:
    """SQL: whether the match x.m holds."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    if kind == "ip":
        part = "regexp_replace(d, '^0+', '')"
        return f"forall(split(x.m, '[.]'), d -> CASE WHEN length({part}) > 3 THEN false WHEN length({part}) = 0 THEN true ELSE cast({part} AS int) <= 255 END)"
    if kind == "card":
        return f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {_luhn(digits)} ELSE false END"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "iban":
        plain = "replace(x.m, ' ', '')"
        turned = f"split(concat(substring({plain}, 5), substring({plain}, 1, 4)), '')"
        return f"length({plain}) BETWEEN 15 AND 34 AND aggregate({turned}, 0L, (s, c) -> CASE WHEN c = '' THEN s WHEN c BETWEEN '0' AND '9' THEN (s * 10 + cast(c AS int)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END) = 1"
    if kind == "national_id":
        return "NOT startswith(x.m, '000') AND NOT startswith(x.m, '666') AND NOT startswith(x.m, '9')"
    return "true"


def _entropy(text: str) -> str:
    """SQL: bits a character of the first 256 characters."""
    chars = f"split(substring({text}, 1, 256), '')"
    share = "(cast(size(filter(cs, c -> c = d)) AS double) / size(cs))"
    return f"element_at(transform(array({chars}), cs -> aggregate(array_distinct(cs), 0D, (s, d) -> s - {share} * log2({share}))), 1)"


def _secret_score(at: float) -> str:
    """SQL: the score of a credential by its shape, or by its value."""
    value = r"regexp_replace(x.m, r'^[^=:]*+[=:]>?[=]?\x20?[\x22\x27]?|[\x22\x27]$', '')"
    classes = " + ".join(f"cast(v RLIKE {_java(p)} AS int)" for p in ("[a-z]", "[^\\s][A-Z]", "[0-9]", "[^A-Za-z0-9\\s.,;:!?'-]"))
    strong = f"(v RLIKE '[0-9]' AND length(v) >= {LONG_SECRET}) OR ({classes} >= 2 AND {_entropy('v')} >= {SOME_BITS}) OR (length(v) >= {LONG_PLAIN} AND NOT v RLIKE r'\\s' AND {_entropy('v')} >= {RICH_BITS})"
    known = "x.m RLIKE " + _java(f"^(?:{'|'.join(SHAPES)}|-----BEGIN|(?i:authorization))")
    return f"if({known}, 0.9D, element_at(transform(array({value}), v -> if({strong}, {at}D, {PLAIN_SECRET}D)), 1))"


def _scored(kind: str) -> str:
    """SQL: array of (start, rank, end, kind, score) of the confirmed spans."""
    at, more = SCORES[kind]
    before = _piece(f"greatest(x.start - {CONTEXT_CHARS}, 0)", "x.start")
    after = _piece("x.end", f"least(x.end + {CONTEXT_CHARS}, n_points)")
    near = f"lower(concat({before}, ' ', {after}))"
    given = _secret_score(at) if kind == "secret" else f"{at}D"
    score = f"{given} + if({near} RLIKE '(?<![a-z])({CONTEXT[kind]})', {more}D, 0D)"
    made = f"transform(filter({_candidates(kind)}, x -> {_confirmed(kind)}), x -> struct(x.start AS start, {KINDS.index(kind)} AS rank, x.end AS end, '{kind}' AS kind, {score} AS score))"
    return made if kind in BASE else f"filter({made}, x -> x.score >= {MIN_SCORE})"


def find_pii(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`docs`, or its columns `keep`, with pii_base and pii_spans: sorted arrays of (start, rank, end, kind, score)."""
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in ("pii_base", "pii_spans")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.struct(*kept).alias("own")
    found = docs.select(own, text.alias("text")).select("own", "text", *[_kept(_gaps(k)).alias(f"gaps_{k}") for k in KINDS])
    lengths = "x.gap + coalesce(length(x.m), 0)"
    found = found.select("*", *[_kept(f"CASE WHEN size(gaps_{k}) > 1 THEN {_before(f'gaps_{k}', '0', lengths, '{0} + {1}')} END").alias(f"before_{k}") for k in KINDS])
    found = found.select("own", "text", *[_kept(_proposed(k)).alias(f"found_{k}") for k in KINDS])
    any_found = " OR ".join(f"size(found_{k}) > 0" for k in KINDS)
    found = found.select("own", *[f"found_{k}" for k in KINDS], F.length("text").alias("n_points"), _kept(f"CASE WHEN {any_found} THEN {_CHUNKS.format('text')} ELSE cast(array() AS array<string>) END").alias("chunks"))
    scored = found.select("own", *[_kept(_scored(k)).alias(k) for k in KINDS])
    base = _kept(f"array_sort(concat({', '.join(BASE)}))").alias("pii_base")
    more = _kept(f"array_sort(concat({', '.join(KINDS)}))").alias("pii_spans")
    return scored.select("own.*", base, more)


def span_string(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans become one. A null text stays null."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{text_col}`").alias("text"))
    found = find_pii(own, text_col="text")
    # spans are sorted by start; one that begins before the furthest end so far belongs to what came before it
    some = found.select("own", "text", "pii_spans", _kept(f"CASE WHEN size(pii_spans) > 0 THEN {_before('pii_spans', '0', 'x.end', 'greatest({0}, {1})')} END").alias("before"))
    entry = "struct(x.start AS start, a.far AS far, x.kind AS kind)"
    block = f"aggregate({{b}}, struct(before[c] AS far, cast(array() AS array<struct<start:int,far:int,kind:string>>) AS cur), (a, x) -> struct(greatest(a.far, x.end) AS far, concat(a.cur, array({entry})) AS cur), a -> a.cur)"
    heads = some.select("own", "text", F.expr("element_at(before, -1)").alias("last"), _kept(f"CASE WHEN before IS NULL THEN cast(array() AS array<struct<start:int,far:int,kind:string>>) ELSE filter(flatten({_blocks('pii_spans', block)}), x -> x.start >= x.far) END").alias("heads"))
    cut = heads.select("own", "text", _kept("transform(heads, (x, i) -> struct(x.start AS start, coalesce(get(heads, i + 1).far, last) AS end, x.kind AS kind))").alias("cut"))
    cut = cut.select("own", "text", "cut", F.length("text").alias("n_points"), _kept(f"CASE WHEN size(cut) > 0 THEN {_CHUNKS.format('text')} END").alias("chunks"))
    kept = _piece("if(i = 0, 0, cut[i - 1].end)", "x.start")
    pieces = f"concat(array_join(transform(cut, (x, i) -> concat({kept}, '[', upper(x.kind), ']')), ''), {_piece('element_at(cut, -1).end', 'n_points')})"
    made = cut.select("own", F.size("cut").alias("n"), _kept(f"CASE WHEN size(cut) = 0 THEN text ELSE {pieces} END").alias("text"))
    out = {c: F.col(f"own.`{c}`") for c in docs.columns}
    out[text_col] = F.col("text")
    if count_col and count_col in docs.columns:
        out[count_col] = F.when(F.col("n") > 0, F.length("text").cast(docs.schema[count_col].dataType)).otherwise(out[count_col])
    return made.select(*[v.alias(c) for c, v in out.items()])
