"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Column expressions only. Spans of one pattern come from marking its matches with two control
characters, splitting at the marks and summing the pieces' lengths; offsets are code points, the end
exclusive. The patterns are written so that matching takes time in proportion to the text: each local
part, digit run and group is possessive, and a run is entered at its start or where the last match
ended.

Base kinds: email, ip (parts at most 255), card (14 to 19 digits passing Luhn), phone (10 to 15
digits); a proposal that fails its check is dropped, without a second try inside it. Kinds the method
adds: iban (mod-97 is 1) and ssn (three groups of digits without a checksum, so that it needs a
context word nearby). Scores: base of the kind, plus 0.3 for a passed checksum, plus 0.2 for a context
word of the kind in the 40 code points before the span or after it, whatever spans lie there; added kinds stay
from a score of 0.6. Pieces are worked off in chunks, so that a text's cost does not grow with the square of its
matches.

Defined cases: null and empty texts have no spans; repeated rows are judged each; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, and the proposals.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.4}
CHECKSUM = {"card", "iban"}
CONTEXT = {
    "email": ["mail", "contact", "write to"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["tel", "phone", "call", "fax", "mobile"],
    "iban": ["iban", "bank", "account"],
    "ssn": ["ssn", "social security", "tax id"],
}
KEEP_FROM = 0.6
WINDOW = 40
#: Pieces of a chunk: even, so that each chunk begins outside a match.
CHUNK = 64
_OPEN, _CLOSE, _PLAIN = "\x01", "\x02", "\x03"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(m: Column) -> Column:
    """Remainder of an IBAN as a number: first four characters last, letters as two digits."""
    flat = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(flat, 5, 100), F.substring(flat, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(
        F.filter(values, lambda v: v >= 0), F.lit(0), lambda acc, v: F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97
    )


def confirmed(kind: str, m: Column) -> Column:
    """The kind's check of a proposed match."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m) == 1
    return F.lit(True)


def parts_of(text: Column, kind: str) -> Column:
    """The text cut at the kind's proposals: what is before, the first match, what is between, the second, and so on."""
    return F.split(F.regexp_replace(text, PATTERN[kind], f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)


def spans_of(parts: Column, kind: str) -> Column:
    """array<struct<start, end, before, after>> of the kind's confirmed matches; ``parts`` is a column of ``parts_of``."""
    empty = F.array().cast("array<struct<start:int,end:int,nth:int>>")
    count = F.floor((F.size(parts) + (CHUNK - 1)) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(parts, k * CHUNK + 1, CHUNK))
    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), acc["nth"].alias("nth"))
        out = F.when((acc["nth"] % 2 == 1) & confirmed(kind, part), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (acc["nth"] + 1).alias("nth"), out.alias("out"))

    def chunk_step(done: Column, chunk: Column) -> Column:
        # a chunk begins where the last one ended, so each piece's length is taken once
        last = F.element_at(done, -1)
        begin = F.struct(last["at"].alias("at"), last["nth"].alias("nth"), empty.alias("out"))
        return F.concat(done, F.array(F.aggregate(chunk, begin, step)))

    # every second piece is a match, so twice the window's pieces hold it
    reach = 2 * WINDOW

    def with_context(s: Column) -> Column:
        first = F.greatest(F.lit(0), s["nth"] - reach)
        before = F.array_join(F.transform(F.slice(parts, first + 1, s["nth"] - first), lambda p: F.right(p, F.lit(WINDOW))), "")
        after = F.array_join(F.transform(F.slice(parts, s["nth"] + 2, reach), lambda p: F.left(p, F.lit(WINDOW))), "")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(F.right(before, F.lit(WINDOW))).alias("before"), F.lower(F.left(after, F.lit(WINDOW))).alias("after"))

    nothing = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("nth"), empty.alias("out")))
    found = F.transform(F.flatten(F.aggregate(chunks, nothing, chunk_step, lambda done: F.transform(done, lambda c: c["out"]))), with_context)
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<struct<start:int,end:int,before:string,after:string>>"))


def scored(kind: str, span: Column) -> Column:
    word = r"(?:^|[^a-z])(?:" + "|".join(CONTEXT[kind]) + ")"
    near = span["before"].rlike(word) | span["after"].rlike(word)
    return F.round(F.lit(PRIOR[kind] + (0.3 if kind in CHECKSUM else 0.0)) + F.when(near, 0.2).otherwise(0.0), 2)


def _row_of(kind: str):
    rank = KINDS.index(kind)
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), scored(kind, s).alias("score"))


def _is(kind: str):
    return lambda r: r["kind"] == kind


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and ``found``, an array of (start, rank, kind, end, score), in order."""
    text = F.translate(F.coalesce(text_col, F.lit("")), _OPEN + _CLOSE, _PLAIN + _PLAIN)
    work = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    work = work.select("doc_id", *[parts_of(F.col("text"), kind).alias(f"parts_{kind}") for kind in KINDS])
    work = work.select("doc_id", *[spans_of(F.col(f"parts_{kind}"), kind).alias(f"raw_{kind}") for kind in KINDS])
    kinds = []
    for kind in KINDS:
        rows = F.transform(f"raw_{kind}", _row_of(kind))
        kinds.append(rows if kind in BASE else F.filter(rows, lambda r: r["score"] >= KEEP_FROM))
    return work.select("doc_id", F.array_sort(F.concat(*kinds)).alias("found"))


def _joined(found: Column, bare: bool = True) -> Column:
    one = lambda r: F.concat_ws(":", r["kind"], r["start"], r["end"])
    return F.array_join(F.transform(found, one if bare else lambda r: F.concat_ws(":", one(r), r["score"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, all spans, and the spans with their scores."""
    found = find_pii(docs, id_col, text_col)
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda r: r["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), _joined(F.col("found"), False).alias("scores"))
