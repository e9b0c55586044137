"""Credentials in text, told from examples by how widely each is copied.

A scan finds candidates of fixed kinds in each text and, beyond them, opaque tokens that mix letters
and digits. Each candidate value is hashed; over the whole corpus the distinct repositories, owners and
texts that hold a hash are counted (summed before they are shuffled). A hash is an example only if it is
widely held: by more than MAX_OWNERS owners, or by several owners in at least WIDE repositories and WIDE
different texts, so that copies of one document under a few owners leave its keys live-looking. A hash of
one owner is live-looking however often that owner repeats it. Candidates beyond the fixed kinds count as
secrets only if live-looking. Owner and repository are column expressions of the caller; the default
takes the column source as owner, and source with lang as repository, for want of better columns.

Defined results: null and empty texts have no spans; candidates under one owner that is null count as
one owner; texts of any length are scanned whole, in time that grows with their length; spans that begin
at one place are listed in the order of KINDS, then by end; repeated rows each get a row and count as
one text; an empty table gives an empty result; extra columns are ignored, whatever their names, and
redacted() keeps them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, materialise, meet

#: Fixed kinds, in the order in which spans at one place are listed.
BASE = ("assign", "access", "hex")
MORE = ("github", "slack", "jwt", "key_block", "opaque")
KINDS = BASE + MORE
#: A value of more owners than this is an example; one of fewer owners (two at least) only if so many repositories and texts hold it.
MAX_OWNERS, WIDE = 4, 5
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so asking for 24 drops the shorter ones
_OPAQUE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_GITHUB = re.compile(r"\bgh[opsur]_[A-Za-z0-9]{36,}")
_SLACK = re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{29,}")
_HEAD = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}")
_BEGIN, _END = (re.compile(rf"-----{x} [A-Z ]*PRIVATE KEY-----") for x in ("BEGIN", "END"))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def tokens_of_three(text: str) -> Iterator[tuple[int, int]]:
    """Web tokens: three dotted parts of eight characters or more, the first beginning with eyJ. Each run is read once."""
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run[0].split(".")
        k = 0
        while k + 2 < len(parts):
            head = _HEAD.search(text, at, at + len(parts[k])) if "eyJ" in parts[k] else None
            if head and len(parts[k + 1]) >= 8 and len(parts[k + 2]) >= 8:
                end = at + sum(map(len, parts[k : k + 3])) + 2
                yield head.start(), end
                at, k = end + 1, k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """From a beginning mark to the next ending one; both kinds of mark are read once."""
    ends = _END.finditer(text)
    end, free = next(ends, None), 0
    for begin in _BEGIN.finditer(text):
        while end and end.start() < begin.end():
            end = next(ends, None)
        if end is None:
            return
        if begin.start() >= free:
            free = end.end()
            yield begin.start(), free


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def candidates(text: str, least_entropy: float = 3.0) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; positions in code points."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    opaque = [m for m in _OPAQUE.finditer(text) if any(c.isdigit() for c in m[0])]
    if opaque:  # a run of 24 hexadecimal digits lies in such a token unless it has no digit
        found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    elif re.search(r"[a-f]{24,}", text):
        found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    if "gh" in text:
        found += [("github", m.start(), m.end(), m[0]) for m in _GITHUB.finditer(text)]
    if "xox" in text:
        found += [("slack", m.start(), m.end(), m[0]) for m in _SLACK.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", a, b, text[a:b]) for a, b in tokens_of_three(text)]
    if "PRIVATE KEY" in text:
        found += [("key_block", a, b, text[a:b]) for a, b in key_blocks(text)]
    starts, ends = merged([(a, b) for _, a, b, _ in found])
    for m in opaque:
        k = bisect_right(starts, m.end() - 1) - 1  # the last span that begins before the token's end
        if (k < 0 or ends[k] <= m.start()) and any(c.isalpha() for c in m[0]) and entropy(m[0]) >= least_entropy:
            found.append(("opaque", m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, repository, owner, digest, found): every candidate of each text, with the hash of its value; digest is that of the text.

    owner and repository default to the column source, and source with lang, where docs has them.
    """
    none = F.lit("")
    owner = owner if owner is not None else F.col("source") if "source" in docs.columns else none
    repository = repository if repository is not None else F.concat_ws("/", "source", "lang") if {"source", "lang"} <= {*docs.columns} else owner

    def run(batch: pa.RecordBatch) -> dict:
        found = [
            [{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32]} for k, a, b, v in candidates(x or "")]
            for x in batch.column("text").to_pylist()
        ]
        return {n: batch.column(n) for n in ("doc_id", "repository", "owner", "digest")} | {"found": found}

    kind = dict(docs.dtypes)[id_col]
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(repository.cast("string"), none).alias("repository"), F.coalesce(owner.cast("string"), none).alias("owner"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    out = arrow_map(df, run, f"doc_id {kind}, repository string, owner string, digest long, found array<struct<kind:string,start:long,end:long,hash:string>>")
    return materialise(out.select(F.monotonically_increasing_id().alias("row"), "*"), "candidates")


def ownership(scanned: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(hash, n_found, n_repositories, n_owners, n_texts, live): how widely each candidate value is held."""
    each = scanned.select("repository", "owner", "digest", F.explode("found.hash").alias("hash"))
    held = each.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_found"), F.count_distinct("owner", "repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.count_distinct("digest").alias("n_texts")
    )
    example = (F.col("n_owners") > max_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= WIDE) & (F.col("n_texts") >= WIDE))
    return held.withColumn("live", ~example)


def owned(scanned: DataFrame, max_owners: int = MAX_OWNERS) -> tuple[DataFrame, int]:
    """(hash, n, n_owners, live) of ownership(), written once, and the number of all candidates."""
    held = materialise(ownership(scanned, max_owners).select("hash", F.col("n_found").alias("n"), "n_owners", "live"), "owners")
    return held, held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) for each row: its spans, each with kind, start, end, n_owners and live.

    Kinds of BASE always stay, live or not; the others stay only if live.
    """
    scanned = scan(docs, owner, repository, id_col, text_col)
    held, total = owned(scanned, max_owners)
    each = scanned.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "f")).select("row", "at", "f.kind", "f.start", "f.end", "f.hash")
    judged = meet(each, held, "hash", total).where(F.col("live") | F.col("kind").isin(*BASE))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "start", "end", "n_owners", "live"))).alias("spans"))
    empty = F.array().cast("array<struct<at:int,kind:string,start:bigint,end:bigint,n_owners:bigint,live:boolean>>")
    return scanned.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """The counts and digests of the result of secrets()."""

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    def listed(keep: Column) -> Column:
        return F.array_join(F.transform(keep, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")

    base = F.filter("found", lambda f: f.kind.isin(*BASE))
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda f: f.live)).cast("long").alias("n_live"), F.size(F.filter("found", lambda f: ~f.live)).cast("long").alias("n_examples"),
    )


def redacted(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with live-looking secrets replaced in text by a mark of their kind; all rows and columns stay.

    Rows are scanned with their text and judged against the corpus-wide ownership table. Marks come back by
    id and text, so rows without an id, and rows that share one, get the marks of their own text.
    """
    mark = "_live"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    of_id, of_text = f"{mark}_id", f"{mark}_text"
    scanned = scan(docs)
    held, total = owned(scanned, max_owners)
    each = scanned.where(F.size("found") > 0).select(F.col("doc_id").alias(of_id), F.col("digest").alias(of_text), F.explode("found.hash").alias("hash"))
    marked = meet(each, held.where("live").select("hash", "n"), "hash", total).groupBy(of_id, of_text).agg(F.collect_set("hash").alias(mark))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        for k, hashes in enumerate(batch.column(mark).to_pylist()):
            text = texts[k]
            if text and hashes:
                known, end = set(hashes), len(text)
                for kind, a, b, v in reversed(candidates(text)):
                    if b <= end and hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32] in known:
                        text, end = f"{text[:a]}<{kind.upper()}>{text[b:]}", a
                texts[k] = text
        return {n: batch.column(n) for n in names} | {"text": texts}

    same = docs["doc_id"].eqNullSafe(F.col(of_id)) & (F.xxhash64(docs["text"]) == F.col(of_text))
    joined = docs.join(marked.hint("merge"), same, "left")  # marks grow with the input: never broadcast
    return arrow_map(joined.select(*names, mark), run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
