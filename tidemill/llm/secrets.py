"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame expressions only. Positions are code points, ends exclusive. A pattern's matches are found with their places by
splitting the text at the pattern: pieces and matches alternate, so running sums of their lengths are the places.

Entropy: a candidate is a run of 20 characters or more of a secret's alphabet. Its character class (hex, mixed-case
alphanumeric with digits, or with symbols) sets the threshold. A window of 20 characters slides over it; the sum of
c log2 c over the window's character counts c is kept up to date by the counts of the one character that enters and of
the one that leaves. A candidate whose highest window entropy is over the threshold is a span of kind ``entropy``, unless
the allow list knows it: letters only (words), one case and no digit, digits only, UUIDs, paths with extension, and
placeholders.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs below 32 characters are dropped anyway, and a run is never part of a longer one.
HEX_LONG = r"[0-9a-f]{32,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Matches whose places are summed together, and windows that are slid over together.
CHUNK = STEP = 256
#: Bits a character in a window of 20, by character class.
HEX_BITS, ALNUM_BITS, SYMBOL_BITS = 3.15, 3.75, 3.85
#: Candidates that are never secrets; whole matches.
ALLOW = (
    r"[A-Za-z_=/+-]+",  # words, no digit
    r"[0-9_=/+-]+",  # numbers and dates
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r".*(?i:example|placeholder|changeme|xxxxxx).*",
)
KINDS = ("assign", "access", "hex", "entropy")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of the leftmost non-overlapping matches, which must not be empty."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(pieces.alias("p"), found.alias("m"))
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")
    width = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["p"])
        to = acc["at"] + width(x)
        one = F.array(F.struct(at.alias("start"), to.alias("end"), x["m"].alias("s")))
        return F.struct(to.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def walked(chunks: Column) -> Column:
        """Arrays grow by copies, so places are summed inside chunks, and over the chunks."""
        total = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + width(x)))
        begin = F.aggregate(total, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(begin, 1, F.size(chunks)), lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step)["out"]))

    cut = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / CHUNK).cast("int")), lambda k: F.slice(b, k * CHUNK + 1, CHUNK))
    return F.when(text.rlike(pattern), let(let(both, cut), walked)).otherwise(empty)


#: c log2 c for the counts c from 0 to WINDOW.
_CLOGC = [c * log2(c) if c else 0.0 for c in range(WINDOW + 1)]


def _highest(piece: Column) -> Column:
    """The least sum of c log2 c, over the counts c of a window's characters, of all windows of WINDOW characters in a piece
    of WINDOW to STEP + WINDOW - 1 characters. Counts are an array with a place for each character of the piece; a step
    takes one from the character that leaves and gives one to the character that enters."""
    clogc = F.array(*[F.lit(x) for x in _CLOGC])
    at = lambda a, i: F.get(a, i)  # noqa: E731  from 0

    def walked(p: Column) -> Column:
        code, first = p["code"], F.slice(p["code"], 1, WINDOW)
        counts = F.transform(F.sequence(F.lit(1), p["kinds"]), lambda k: F.size(F.filter(first, lambda c: c == k)))
        start = F.aggregate(counts, F.lit(0.0), lambda a, c: a + at(p["clogc"], c))

        def slide(acc: Column, i: Column) -> Column:
            def step(x: Column) -> Column:
                n, out, into = acc["n"], x["out"], x["into"]
                low, high = F.least(out, into), F.greatest(out, into)
                given = F.when(into < out, 1).otherwise(-1)  # to the lower of the two places
                moved = F.concat(F.slice(n, F.lit(1), low - 1), F.array(at(n, low - 1) + given), F.slice(n, low + 1, high - low - 1), F.array(at(n, high - 1) - given), F.slice(n, high + 1, p["kinds"]))
                left, entered = at(n, out - 1), at(n, into - 1)
                value = acc["now"] - at(p["clogc"], left) + at(p["clogc"], left - 1) - at(p["clogc"], entered) + at(p["clogc"], entered + 1)
                return F.when(out == into, acc).otherwise(F.struct(moved.alias("n"), value.alias("now"), F.least(acc["least"], acc["now"]).alias("least")))

            return let(F.struct(at(code, i).alias("out"), at(code, i + WINDOW).alias("into")), step)

        steps = F.slice(F.sequence(F.lit(0), F.size(code)), 1, F.size(code) - WINDOW)
        return F.aggregate(steps, F.struct(counts.alias("n"), start.alias("now"), start.alias("least")), slide, lambda acc: F.least(acc["least"], acc["now"]))

    chars = F.split(piece, "")
    coded = lambda c: let(F.array_distinct(c), lambda kinds: F.struct(F.transform(c, lambda x: F.array_position(kinds, x).cast("int")).alias("code"), F.size(kinds).alias("kinds"), clogc.alias("clogc")))
    return let(let(chars, coded), walked)


def window_entropy(s: Column) -> Column:
    """The highest Shannon entropy, in bits a character, of all windows of WINDOW characters in ``s`` (ASCII, not shorter). A
    long run is cut into pieces of STEP windows, by bytes, so that a step costs the same at any place of it."""
    begins = F.sequence(F.lit(0), F.length(s) - WINDOW, F.lit(STEP))
    pieces = let(s.cast("binary"), lambda b: F.transform(begins, lambda i: F.substring(b, i + 1, F.lit(STEP + WINDOW - 1)).cast("string")))
    return F.log2(F.lit(float(WINDOW))) - F.array_min(F.transform(pieces, _highest)) / WINDOW


def entropy_spans(text: Column) -> Column:
    threshold = lambda s: F.when(s.rlike(r"^[0-9a-fA-F]+$"), HEX_BITS).when(s.rlike(r"^[A-Za-z0-9]+$"), ALNUM_BITS).otherwise(SYMBOL_BITS)
    allowed = lambda s: reduce(lambda a, b: a | b, [s.rlike(f"^(?:{p})$") for p in ALLOW])
    plausible = F.filter(spans(text, CANDIDATE), lambda x: ~allowed(x["s"]))
    return F.filter(plausible, lambda x: window_entropy(x["s"]) > threshold(x["s"]))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets`` added: array<struct<start, kind_no, end, kind>>, ordered by start and kind, of every
    span in the whole text (null: empty). A column of that name is replaced; rows are kept as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(spans(text, ASSIGN), lambda x: F.length(F.regexp_replace(x["s"], ASSIGN_HEAD, "")) >= 8)
    found = (assign, spans(text, ACCESS_LONG), spans(text, HEX_LONG), entropy_spans(text))

    def tagged(no: int, kind: str, a: Column) -> Column:
        return F.transform(a, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    every = [tagged(no, kind, a) for no, (kind, a) in enumerate(zip(KINDS, found, strict=True))]
    return docs.withColumn("secrets", F.array_sort(F.concat(*every)))


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and positions of the spans of each row of ``docs``; see ``scan``."""
    n = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["kind_no"] < 3)
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret in the text replaced by ``mask``; overlapping spans become one. Texts without
    secrets, null included, stay as they are."""
    text = F.col(text_col)
    # overlapping spans as one, (a, z), in order: one begins where no span before reaches; sums in chunks, as in ``spans``
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int")), lambda k: F.slice(r, k * CHUNK + 1, CHUNK))
    most = lambda c: F.array_max(F.transform(c, lambda x: x["end"]))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["start"].alias("a"), acc["far"].alias("before")))
        return F.struct(F.greatest(acc["far"], x["end"]).alias("far"), F.when(x["start"] >= acc["far"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def merged(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.greatest(F.element_at(a, -1), most(c)))))
        none = F.array().cast("array<struct<a:int,before:int>>")
        first = lambda at: F.flatten(F.zip_with(chunks, F.slice(at, 1, F.size(chunks)), lambda c, z: F.aggregate(c, F.struct(z.alias("far"), none.alias("out")), step)["out"]))
        ends = lambda at, r: F.concat(F.transform(F.slice(r, 2, F.size(r)), lambda x: x["before"]), F.array(F.element_at(at, -1)))
        return let(before, lambda at: let(first(at), lambda r: F.zip_with(r, ends(at, r), lambda x, z: F.struct(x["a"].alias("a"), z.alias("z")))))

    reach = let(cut(F.col("secrets")), merged)

    def between(r: Column) -> Column:
        """The pieces of the text around the spans, one more than these."""
        begin = lambda i: F.when(i > 0, F.element_at(r, F.greatest(i, F.lit(1)))["z"]).otherwise(0)
        end = lambda i: F.when(i < F.size(r), F.element_at(r, F.least(i + 1, F.size(r)))["a"]).otherwise(F.length(text))

        def chunk(k: Column) -> Column:
            """CHUNK pieces from their own stretch of the text: finding a place in a text costs as much as it is far."""
            first, last = k * CHUNK, F.least(k * CHUNK + (CHUNK - 1), F.size(r))
            stretch = F.struct(begin(first).alias("at"), F.substr(text, begin(first) + 1, end(last) - begin(first)).alias("s"))
            return let(stretch, lambda x: F.transform(F.sequence(first, last), lambda i: F.substr(x["s"], begin(i) - x["at"] + 1, end(i) - begin(i))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(r) / CHUNK).cast("int")), chunk))

    masked = F.array_join(let(reach, between), mask)
    kept = [c for c in docs.columns if c != "secrets"]
    return scan(docs.select(*kept), text_col).withColumn(text_col, F.when(F.size("secrets") > 0, masked).otherwise(text)).select(*kept)


_SPANS = """list_filter(list_transform(range(1, len(p{k}) + 1), lambda i: {{
        'start': CAST(list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + COALESCE(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        's': m{k}[i]}}), lambda x: x.s IS NOT NULL)"""
_ENTROPY = """list_max(list_transform(range(1, length(x.s) - 18), lambda i: list_sum(list_transform(list_distinct(string_split(substr(x.s, i, 20), '')),
        lambda ch: -((20 - length(replace(substr(x.s, i, 20), ch, ''))) / 20.0) * log2((20 - length(replace(substr(x.s, i, 20), ch, ''))) / 20.0)))))"""


def oracle() -> str:
    patterns = {0: ASSIGN, 1: ACCESS_LONG, 2: HEX_LONG, 3: CANDIDATE}
    quoted = {k: v.replace("'", "''") for k, v in patterns.items()}
    cut = ",\n    ".join(f"string_split_regex(t, '{v}') AS p{k}, regexp_extract_all(t, '{v}') AS m{k}" for k, v in quoted.items())
    allowed = " OR ".join(f"regexp_full_match(x.s, '{p}')" for p in ALLOW)
    keep = {
        0: f"length(regexp_replace(x.s, '{ASSIGN_HEAD.replace(chr(39), chr(39) * 2)}', '')) >= 8", 1: "true", 2: "true",
        3: f"""NOT ({allowed}) AND {_ENTROPY} > CASE WHEN regexp_full_match(x.s, '[0-9a-fA-F]+') THEN {HEX_BITS}
        WHEN regexp_full_match(x.s, '[A-Za-z0-9]+') THEN {ALNUM_BITS} ELSE {SYMBOL_BITS} END""",
    }
    kinds = ",\n    ".join(
        f"list_transform(list_filter({_SPANS.format(k=k)}, lambda x: {keep[k]}), lambda x: {{'start': x.start, 'no': {k}, 'stop': x.start + length(x.s), 'kind': '{name}'}}) AS a{k}"
        for k, name in enumerate(KINDS)
    )
    joined = "COALESCE(array_to_string(list_transform({x}, lambda y: y.kind || ':' || y.start || ':' || y.stop), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
c AS (SELECT doc_id, {cut} FROM d),
k AS (SELECT doc_id, {kinds} FROM c),
o AS (SELECT *, list_sort(list_concat(list_concat(a0, a1), a2)) AS base, list_sort(list_concat(list_concat(list_concat(a0, a1), a2), a3)) AS everything FROM k)
SELECT doc_id, CAST(len(a0) AS BIGINT) AS n_assign, CAST(len(a1) AS BIGINT) AS n_access, CAST(len(a2) AS BIGINT) AS n_hex,
    sha256({joined.format(x="base")}) AS base_sha256, {joined.format(x="everything")} AS spans
FROM o
"""
