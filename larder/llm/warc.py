"""Web archives (operator 13): writing WARC files and reading them back in parallel.

Writing. A page is one record: an HTTP response with the page's bytes as payload. Of
records with equal payloads of at least ``least`` bytes, the one with the largest id holds the payload
(``response``), the others are ``revisit`` records that refer to it. Files are written by
Spark's text writer, one record a line, with the record end of the format as line end; so
they land in any store Spark can write, and a lost executor's files are written again.

Reading. A file is cut anywhere into splits, and record starts are found by the
magic "WARC/1.", which payloads may hold too. So records are found by a
chain that is verified from the start of each file:

1. Spark's text reader cuts the files at the magic, split by split. A task turns each
   piece into a candidate: its header, and the offset of its successor as the header's length
   says. Offsets count from the first piece of the split; sums of the pieces' lengths
   give every split's place in its file.
2. Within a split, each candidate's chain is followed to the first offset beyond it.
3. Pointer jumping over these exits, doubling the distance each round, marks what is
   reachable from the start of each file: at most one entry for each split.
4. The chain of each entry marks the records; all other candidates lie inside payloads.
5. A record whose payload holds the magic was cut into pieces; those pieces alone are read
   again and joined. All other payloads are measured in step 1 and never move.

Defined results: null html is an empty payload; a null url has no target; control characters
and spaces in a url are percent-encoded in the header; rows with a null id take no part
in revisits; rows that share the largest id of their group are all responses. Repeated rows
give repeated records. An empty table writes files without records. Reading stops, file by
file, at the first offset where no whole record begins: what lies behind it is not returned.
Columns beside id, url and html are ignored when writing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import Scratch

# Fixed values of the format.
MAGIC = "WARC/1."
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LEAST_REVISIT = 1000
DATE = "2001-01-01T00:00:00Z"
ID_FIELD = "X-Page-Id"


# --------------------------------------------------------------------- writing

def record_id(page_id: Column, digest: Column) -> Column:
    """A record's URN, the same whenever a task runs again."""
    h = F.md5(F.concat_ws("|", F.lit("page"), page_id.cast("string"), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-a"),
                    part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def base32_digest(digest: Column) -> Column:
    """A SHA-1 (40 hexadecimal digits) as the 32 characters that archives use: 8 for each 5 bytes."""
    out = []
    for a in range(0, 40, 10):
        number = F.conv(F.substring(digest, a + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, 1)
                for i in range(8)]
    return F.concat(*out)


def header_text(url: Column) -> Column:
    """A url that fits one header line: control characters and spaces percent-encoded."""
    odd = "[\\x00-\\x20\\x7F]"
    parts = F.split(url, f"(?={odd})|(?<={odd})")
    clean = F.concat_ws("", F.transform(parts, lambda c: F.when(
        c.rlike(f"^{odd}$"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)))
    return F.when(url.rlike(odd), clean).otherwise(url)


def records(pages: DataFrame, scratch: Scratch, least: int = LEAST_REVISIT, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """``record``: the text of one WARC record for each page, without the record end."""
    own = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"),
                       F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    own = own.withColumns({"bytes": F.octet_length("html"), "digest": F.sha1("html")})
    # One row for each payload that occurs under several ids, combined before the shuffle.
    shared = own.where((F.col("bytes") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(
        F.max("id").alias("holder"), F.min("id").alias("first")).where("holder > first").select("digest", "holder")
    own = own.join(scratch.write(shared), "digest", "left")
    revisit = F.col("holder").isNotNull() & F.col("id").isNotNull() & (F.col("bytes") >= least) & (F.col("id") < F.col("holder"))
    own = own.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    block = F.concat(F.lit(HTTP_HEAD), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    length = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes")) + F.lit(len(HTTP_HEAD))
    refers = F.when(F.col("revisit"), F.concat(
        F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"),
        line("WARC-Refers-To", record_id(F.col("holder"), F.col("digest"))))).otherwise(F.lit(""))
    text = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("id"), F.col("digest"))),
        line("WARC-Date", F.lit(DATE)), some("WARC-Target-URI", header_text(F.col("url"))),
        some(ID_FIELD, F.col("id").cast("string")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_digest(F.col("digest")))),
        refers, line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")), F.lit("\r\n"), block)
    return own.select(text.alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, page_id: str = "page_id", url: str = "url",
                   html: str = "html") -> str:
    """Writes one record for each page into files under ``path`` (a new folder)."""
    records(pages, Scratch(pages.sparkSession), least, page_id, url, html).write.option("lineSep", RECORD_END).text(path)
    return path


# --------------------------------------------------------------------- reading

_PIECE = ("file string, split long, rel long, size long, succ long, type string, record_id string, target string, "
          "page_id string, digest string, refers_to string, payload_bytes long, payload_sha1 string")
# Header fields of a piece, by the name in the file (lower case).
_FIELDS = {"warc-type": "type", "warc-record-id": "record_id", "warc-target-uri": "target", ID_FIELD.lower(): "page_id",
           "warc-payload-digest": "digest", "warc-refers-to": "refers_to"}
_VERSION = re.compile(rb"\d\r\n")


def parse_header(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """(length of the header with its empty line, fields) of a piece behind the magic; None if it has none."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or not _VERSION.match(piece):
        return None
    fields: dict[str, str] = {}
    for line in piece[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    size = fields.get("content-length", "")
    return (end + 4, fields) if size.isascii() and size.isdigit() and len(size) < 16 else None


def payload_of(block: bytes, fields: dict[str, str]) -> bytes:
    """What the archive stores of the page: the block, less the HTTP header if it is an HTTP message."""
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _raw_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, piece): the bytes between magics, in the order of the file within each split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.col("value").cast("binary").alias("piece"))


def _places(batch: pa.RecordBatch, state: list) -> list[int]:
    """Offset of each row's piece, magic included, from the first piece of its split; state: (file, split, next)."""
    out = []
    for file, split, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
        if (file, split) != tuple(state[:2]):
            state[:] = [file, split, 0]
        out.append(state[2])
        state[2] += len(piece) + len(MAGIC)
    return out


def _candidate_task(batches):
    state: list = [None, None, 0]
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in _PIECE.split(", ")}
        places = _places(batch, state)
        for file, split, rel, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places,
                                           batch.column(2).to_pylist()):
            size, parsed = len(piece) + len(MAGIC), parse_header(piece)
            row = {"file": file, "split": split, "rel": rel, "size": size}
            if parsed:
                head, fields = parsed
                length = int(fields["content-length"])
                row["succ"] = len(MAGIC) + head + length + len(RECORD_END)
                row |= {name: fields.get(field) for field, name in _FIELDS.items()}
                if row["succ"] == size:
                    payload = payload_of(piece[head:head + length], fields)
                    row |= {"payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()}
                    if not piece.endswith(b"\r\n\r\n"):
                        row["succ"] = None
            for c, values in out.items():
                values.append(row.get(c))
        yield pa.RecordBatch.from_pydict(out, schema=_arrow_schema(_PIECE))


def _arrow_schema(ddl: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")])


def _exits(rel: np.ndarray, succ: np.ndarray, end: int) -> np.ndarray:
    """Offset beyond the split that each candidate's chain comes to; -1 where it breaks off."""
    out = np.full(len(rel), -1, np.int64)
    index = {int(r): i for i, r in enumerate(rel)}
    for i in range(len(rel) - 1, -1, -1):
        if succ[i] >= 0:
            to = int(rel[i] + succ[i])
            if to >= end:
                out[i] = to
            elif to in index:
                out[i] = out[index[to]]
    return out


def _split_rows(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    group = group.sort_by("rel")
    rel = group.column("rel").to_numpy()
    succ = pa.compute.fill_null(group.column("succ"), -1).to_numpy()
    return group, rel, succ


def _exit_task(group: pa.Table) -> pa.Table:
    """Each candidate of a split with the place its chain leaves the split at."""
    group, rel, succ = _split_rows(group)
    base = group.column("base")[0].as_py()
    end = group.column("length")[0].as_py()
    out = _exits(rel, succ, end)
    live = out >= 0
    return pa.table({"file": group.column("file").filter(pa.array(live)), "at": pa.array(rel[live] + base),
                     "leaves": pa.array(out[live] + base)})


def _chain_task(group: pa.Table) -> pa.Table:
    """The records of a split: the chain from its entry."""
    group, rel, succ = _split_rows(group)
    base, entry = group.column("base")[0].as_py(), group.column("entry")[0].as_py()
    index = {int(r): i for i, r in enumerate(rel)}
    i, taken = index.get(entry - base), []
    while i is not None and succ[i] >= 0:
        taken.append(i)
        i = index.get(int(rel[i] + succ[i]))
    return pa.table({"file": group.column("file").take(pa.array(taken, pa.int64())),
                     "split": group.column("split").take(pa.array(taken, pa.int64())),
                     "rel": pa.array(rel[taken] if taken else [], pa.int64())})


def _splits(pieces: DataFrame) -> DataFrame:
    """(file, split, length, base, file_end): where each split's first piece lies in its file.

    Offsets count from the first magic: the empty piece before it has the length of a magic, which
    is taken off. A row for each split, so the window over a file runs over few.
    """
    sums = pieces.groupBy("file", "split").agg(F.sum("size").alias("length"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({"base": F.coalesce(F.sum("length").over(before), F.lit(0)) - len(MAGIC),
                             "file_end": F.sum("length").over(Window.partitionBy("file")) - len(MAGIC)})


def reachable(starts: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at): what the starts (file, at) lead to, by pointer jumping over (file, at, leaves).

    Round r knows all within 2^r steps, and where 2^r steps lead from every node. Only offsets that
    some chain leaves to are nodes: a few for each split.
    """
    ends = edges.select("file", F.col("leaves").alias("at")).distinct()
    nodes = starts.unionByName(ends).distinct()
    jump = scratch.write(edges.join(nodes, ["file", "at"], "left_semi"))
    found = scratch.write(starts)
    while True:
        further = found.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        now = scratch.write(found.unionByName(further).distinct())
        if now.count() == found.count():
            return now
        found = now
        to = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("after"))
        jump = scratch.write(jump.join(to, ["file", "leaves"]).select("file", "at", F.col("after").alias("leaves")))


def chain(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, split, rel, base) of the pieces that begin a record."""
    small = pieces.select("file", "split", "rel", "size", "succ")
    splits = scratch.write(_splits(small))
    placed = small.join(splits, ["file", "split"])
    # A record that its file cuts short is none.
    placed = placed.withColumn("succ", F.when(F.col("base") + F.col("rel") + F.col("succ") <= F.col("file_end"), F.col("succ")))
    keys = ["file", "split", "base", "length", "rel", "succ"]
    edges = scratch.write(placed.select(*keys).groupBy("file", "split").applyInArrow(
        _exit_task, "file string, at long, leaves long"))
    starts = splits.select("file", F.lit(0).cast("long").alias("at")).distinct()
    entries = reachable(starts, edges, scratch)
    # An entry lies in the split whose pieces cover it; the end of a file lies in none.
    inside = entries.join(splits, "file").where((F.col("at") >= F.col("base")) & (F.col("at") < F.col("base") + F.col("length")))
    # The first split starts with the empty piece before the first magic.
    inside = inside.select("file", "split", F.col("at").alias("entry"))
    marked = placed.select(*keys).join(scratch.write(inside), ["file", "split"])
    found = marked.groupBy("file", "split").applyInArrow(_chain_task, "file string, split long, rel long")
    return found.join(splits.select("file", "split", "base"), ["file", "split"])


def _joined_task(group: pa.Table) -> pa.Table:
    """One record from its pieces; without the record end where its length points, it is none."""
    group = group.sort_by("order")
    whole = MAGIC.encode().join(group.column("piece").to_pylist())
    head, fields = parse_header(whole)
    length = int(fields["content-length"])
    good = whole[head + length:head + length + len(RECORD_END)] == RECORD_END.encode()
    payload = payload_of(whole[head:head + length], fields)
    return pa.table({
        "file": group.column("file").slice(0, 1), "at": group.column("owner_at").slice(0, 1),
        "joined_bytes": pa.array([len(payload) if good else None], pa.int64()),
        "joined_sha1": pa.array([hashlib.sha1(payload).hexdigest() if good else None], pa.string())})


def _place_task(batches):
    state: list = [None, None, 0]
    for batch in batches:
        places = _places(batch, state)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())],
                                         names=["file", "split", "piece", "rel"])


def _cut_payloads(scratch: Scratch, path: str, cut: DataFrame, pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, at, joined_bytes, joined_sha1) of records whose payload holds the magic: their pieces, read again.

    A record meets its pieces in the splits that it covers, by split and then by offset.
    """
    covers = cut.select("file", "at", (F.col("at") + F.col("succ")).alias("end")).join(splits, "file") \
        .where((F.col("base") + F.col("length") > F.col("at")) & (F.col("base") < F.col("end"))) \
        .select("file", "split", "base", F.col("at").alias("owner_at"), "end")
    parts = pieces.select("file", "split", "rel").join(covers, ["file", "split"]).withColumn("order", F.col("base") + F.col("rel")) \
        .where((F.col("order") >= F.col("owner_at")) & (F.col("order") < F.col("end"))) \
        .select("file", "split", "rel", "order", "owner_at")
    raw = _raw_pieces(scratch.spark, path).mapInArrow(_place_task, "file string, split long, piece binary, rel long")
    return raw.join(scratch.write(parts), ["file", "split", "rel"]).groupBy("file", "owner_at").applyInArrow(
        _joined_task, "file string, at long, joined_bytes long, joined_sha1 string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, type, record_id, target, page_id, digest, refers_to, payload_bytes, payload_sha1) of every record.

    ``digest``: as the header has it; ``payload_bytes`` and ``payload_sha1``: of the payload stored in
    the record (a revisit has none).
    """
    scratch = Scratch(spark)
    pieces = scratch.write(_raw_pieces(spark, path).mapInArrow(_candidate_task, _PIECE))
    found = scratch.write(chain(pieces, scratch).withColumn("at", F.col("base") + F.col("rel")))
    out = pieces.join(found, ["file", "split", "rel"])
    cut = scratch.write(out.where("succ != size").select("file", "at", "succ"))
    if not cut.isEmpty():
        joined = scratch.write(_cut_payloads(scratch, path, cut, pieces, _splits(pieces)))
        out = out.join(joined, ["file", "at"], "left").where("succ = size or joined_sha1 is not null")
        out = out.withColumns({"payload_bytes": F.coalesce("payload_bytes", "joined_bytes"),
                               "payload_sha1": F.coalesce("payload_sha1", "joined_sha1")})
    return out.select("file", "at", "type", "record_id", "target", "page_id", "digest", "refers_to", "payload_bytes",
                      "payload_sha1")


def resolve_revisits(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Records with the size and digest of their full payload, and the page they refer to.

    A revisit takes them from the record it refers to. Records that are referred to are one row each,
    however many revisits they have.
    """
    found = scratch.write(found)
    named = found.where("type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    holders = found.where("type = 'response'").join(named, "record_id", "left_semi").groupBy("record_id").agg(
        F.max("payload_bytes").alias("full_bytes"), F.max("payload_sha1").alias("full_sha1"), F.max("page_id").alias("holder"))
    holders = scratch.write(holders.withColumnRenamed("record_id", "refers_to"))
    out = found.join(holders, "refers_to", "left")
    own = F.col("type") != "revisit"
    return out.select(
        "page_id", F.when(own, F.col("payload_bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(own, F.col("payload_sha1")).otherwise(F.col("full_sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(~own, F.col("holder")).alias("refers_to"), "target", "digest")
