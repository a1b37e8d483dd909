"""Merkle fixity audit of WARC archives.

An archive is a table of records: file, ordinal (place in the file), offset and length in bytes, and digest. A leaf hashes a
record's digest with its offset range; a node hashes the hashes of up to FANOUT children in order, first within each file and
then over the files, up to one root. Two replicas are compared from their roots down: at each level only children of nodes
that differ are looked at, so an intact branch costs one comparison however many records it holds.

All of it is DataFrame operations: a level is one grouping by parent, whose groups hold FANOUT rows at most.

Defined cases: null urls and bodies count as empty; records without an id come in a file of their own, -1; repeated ids stand one
after the other, in the order of their digests, so that repeated rows are records of their own; a body of any length is one record, hashed
where it is; columns other than those named are not read, so that none can clash; two empty archives have equal (null) roots and no
damage.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvane.llm import shared

#: Children of a node at most; records of consecutive ids that a file holds.
FANOUT, FILE_RECORDS = 16, 256


def render(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key and record: every page as the text of a WARC/1.0 resource record."""
    text = F.coalesce(pages[body], F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(pages[key].cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(pages[url], F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(pages[key].alias("key"), F.concat(head, text, F.lit("\r\n\r\n")).alias("record"))


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields (names in lower case) and body of each record of a WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *fields = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        head = {name.strip().lower(): value.strip() for name, _, value in (f.partition(":") for f in fields)}
        body = stop + 4
        end = body + int(head["content-length"])
        yield at, end + 4 - at, head, data[body:end]
        at = end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, offset, length and digest of every record of the WARC files under a path; a file is one task's work."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(name, k, a, n, hashlib.sha256(data[a : a + n]).hexdigest()) for k, (a, n, _, _) in enumerate(parse(data))]
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "ordinal", "offset", "length", "digest"), r, strict=True)) for r in rows], schema=kinds)

    kinds = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ordinal long, offset long, length long, digest string")


def layout(records: DataFrame) -> DataFrame:
    """Records (key, record) in files of consecutive keys: file, ordinal, key, offset, length and digest."""
    rows = records.select(
        F.coalesce(F.floor(F.col("key") / FILE_RECORDS), F.lit(-1)).cast("long").alias("file"),
        "key",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
    )
    order = Window.partitionBy("file").orderBy("key", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "file",
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        "key",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        "length",
        "digest",
    )


#: Scope of nodes above the files; a node within a file has the file as its scope.
ARCHIVE = -2


def _steps(n: int) -> int:
    """Levels above n nodes."""
    steps = 0
    while n > 1:
        n, steps = -(-n // FANOUT), steps + 1
    return steps


def shape(*archives: DataFrame) -> tuple[int, int]:
    """Levels within a file and above the files that suffice for all the archives."""
    most, files = 1, 1
    for archive in archives:
        size = archive.agg(F.max("ordinal").alias("n"), F.max("file").alias("files")).first()
        if size.n is not None:
            most, files = max(most, size.n + 1), max(files, size.files + 2)
    return max(1, _steps(most)), _steps(files)


def tree(archive: DataFrame, levels: tuple[int, int]) -> list[DataFrame]:
    """The levels, leaves first: scope, place and hash of every node, and its parent's scope and place (up_scope, up)."""
    inner, outer = levels
    leaf = F.sha2(F.concat_ws(":", "ordinal", "offset", "length", "digest"), 256)
    now = archive.select(F.col("file").alias("scope"), F.col("ordinal").alias("place"), leaf.alias("hash"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda c: c["hash"]), "")
    out = []
    for k in range(inner + outer + 1):
        if k == inner - 1:
            up_scope, up = F.lit(ARCHIVE).cast("long"), F.col("scope") + 1
        else:
            up_scope, up = F.col("scope"), F.floor(F.col("place") / FANOUT)
        out.append(now.withColumns({"up_scope": up_scope, "up": up}))
        # Written once: a level is made of the one below, not of the records again.
        if k < inner + outer:
            now = shared.written(out[-1].groupBy(F.col("up_scope").alias("scope"), F.col("up").alias("place")).agg(F.sha2(joined, 256).alias("hash")), "fixity-level")
    return out


def root(archive: DataFrame) -> str | None:
    """The hash at the top of an archive's tree."""
    top = tree(archive, shape(archive))[-1].first()
    return top and top.hash


def damaged(good: DataFrame, other: DataFrame) -> DataFrame:
    """Records of two replicas that differ: file, ordinal, and kind: changed (its bytes), moved (the same bytes at another offset, as
    after a record that lost some), missing (not in the other) or extra (not in the good one)."""
    levels = shape(good, other)
    left, right = tree(good, levels), tree(other, levels)
    differ = None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        if differ is not None:
            parent = differ.select(F.col("scope").alias("up_scope"), F.col("place").alias("up"))
            a, b = (x.join(parent, ["up_scope", "up"], "left_semi") for x in (a, b))
        a, b = a.select("scope", "place", F.col("hash").alias("x")), b.select("scope", "place", F.col("hash").alias("y"))
        differ = a.join(b, ["scope", "place"], "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
        if a is not left[0]:
            differ = shared.written(differ, "fixity-branches")
    found = differ.select(F.col("scope").alias("file"), F.col("place").alias("ordinal"), "x", "y")
    for rows, name in ((good, "was"), (other, "is")):
        found = found.join(rows.select("file", "ordinal", F.struct("length", "digest").alias(name)), ["file", "ordinal"], "left")
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("was") == F.col("is"), "moved").otherwise("changed")
    return found.select("file", "ordinal", kind.alias("kind"))
