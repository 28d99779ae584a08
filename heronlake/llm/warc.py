"""WARC archives and their Merkle fixity audit.

A record's leaf is the digest of its bytes; a node is the digest of an ordered offset range, made from the
offsets, lengths and digests of its ``FANOUT`` children; each file has a root. Two replicas are compared root by
root, and only below roots and nodes that differ are children compared, down to the records. What is left on both sides
is aligned by record, so that a record lost or added doesn't make those behind it look damaged.

Defined cases: null urls and payloads are empty; a record that only one replica has is ``missing`` or
``extra``, one of equal bytes at another place is ``moved``, one of other bytes ``corrupt``; repeated records are records
of their own (order: key, url, digest) and those of equal bytes are aligned first; they share a file; an empty archive has no
roots and no findings; extra columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronlake.llm.common import written

FANOUT = 16
#: Records of a file, on average.
PER_FILE = 512
CRLF = "\r\n"
#: WARC-Date of records whose table has no date.
UNDATED = "1970-01-01T00:00:00Z"


def record_text(url: Column, key: Column, payload: Column, date: Column | None = None) -> Column:
    """A WARC/1.0 resource record without the two line ends that close it."""
    uid = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), url))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:md5:"), uid, F.lit(f">{CRLF}WARC-Target-URI: "),
        F.regexp_replace(url, "[\r\n]", ""), F.lit(f"{CRLF}WARC-Date: "), F.lit(UNDATED) if date is None else date, F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head, payload)


def archived(df: DataFrame, n_files: int, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> DataFrame:
    """key, url, file, record: rows as records, dealt to ``n_files`` files by a digest of key and url. ``date_col`` has timestamps."""
    url, payload = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(payload_col), F.lit(""))
    date = F.coalesce(F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(UNDATED)) if date_col else F.lit(UNDATED)
    d = df.select(F.col(key_col).alias("key"), url.alias("url"), payload.alias("payload"), date.alias("date"))
    file = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("null")), "url")), 1, 13), 16, 10).cast("long"), F.lit(n_files))
    return d.select("key", "url", file.alias("file"), record_text(F.col("url"), F.col("key"), F.col("payload"), F.col("date")).alias("record"))


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes ``archived`` records as WARC files, one folder ``file=N`` for each; Spark's text writer puts the two
    closing line ends after each record."""
    w = records.repartition("file").sortWithinPartitions("file", "key", "url").select("file", "record").write.partitionBy("file").option("lineSep", CRLF * 2)
    (w.option("compression", compression) if compression else w).text(path)


def parsed(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, payload) of the records of a binary stream of WARC bytes, one at a time. Lengths come from
    Content-Length, so payloads may hold anything; offsets count bytes that aren't compressed."""
    at = 0
    while line := stream.readline():
        start = at
        at += len(line)
        if not line.strip():
            continue  # line ends between records
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at offset {start}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        at += len(line)
        payload = stream.read(n := int(head.get("content-length", "0")))
        if len(payload) < n:
            raise ValueError(f"the record at offset {start} is cut off")
        at += n
        yield start, at - start, head, payload


def read_warc(spark: SparkSession, path: str, names: str = "{*.warc,*.warc.gz,part-*}") -> DataFrame:
    """path, seq, offset, length, type, date, url, payload (binary) of every record of the files with such names below ``path``,
    plain or gzipped (as a whole or by record). A file is read by one task, and unpacked record by record."""
    import gzip
    import io

    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), *[(c, pa.string()) for c in ("type", "date", "url")], ("payload", pa.binary())])

    def parse(batches: Iterator) -> Iterator:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                raw = io.BytesIO(content.as_buffer())
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows, held = [], 0
                for seq, (offset, length, head, payload) in enumerate(parsed(gzip.GzipFile(fileobj=raw) if zipped else raw)):
                    rows.append((name.as_py(), seq, offset, length, head.get("warc-type"), head.get("warc-date"), head.get("warc-target-uri", ""), payload))
                    held += length
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return files.select("path", "content").mapInArrow(parse, "path string, seq long, offset long, length long, type string, date string, url string, payload binary")


def leaves(records: DataFrame) -> DataFrame:
    """key, file, seq, offset, length, hash, id (digest of key and url) for each record; order in a file is by key, url, digest."""
    d = records.select("key", "url", "file", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record"), 256).alias("hash"))
    w = Window.partitionBy("file").orderBy("key", "url", "hash")
    d = d.withColumn("seq", F.row_number().over(w).cast("long") - 1)
    d = d.withColumn("offset", F.coalesce(F.sum(F.col("length") + 4).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return d.select("key", "file", "seq", "offset", "length", "hash", F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("null")), "url").alias("id"))


def tree(leaf: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes by level, leaves first: file, node, offset, length, hash. The last level has the roots."""
    out = [leaf.select("file", F.col("seq").alias("node"), "offset", "length", "hash")]
    for _ in range(levels):
        kids = out[-1].select("file", F.floor(F.col("node") / fanout).alias("node"), F.struct(F.col("node").alias("i"), "offset", "length", "hash").alias("kid"))
        kids = kids.groupBy("file", "node").agg(F.sort_array(F.collect_list("kid")).alias("kids"))
        told = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["offset"], k["length"], k["hash"])), ",")
        span = F.element_at("kids", -1)
        out.append(kids.select("file", "node", F.col("kids")[0]["offset"].alias("offset"), (span["offset"] + span["length"] - F.col("kids")[0]["offset"]).alias("length"), F.sha2(told, 256).alias("hash")))
    return out


def levels_for(most_records: int, fanout: int = FANOUT) -> int:
    n = 1
    while fanout**n < most_records:
        n += 1
    return n


def suspects(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, seq of the places at which replicas ``a`` and ``b`` (``leaves``) differ, found by descent from the roots."""
    most = a.agg(F.max("seq")).unionByName(b.agg(F.max("seq"))).agg(F.max("max(seq)")).first()[0]
    levels = levels_for((most if most is not None else -1) + 1, fanout)
    ta, tb = tree(a, levels, fanout), tree(b, levels, fanout)
    found = None
    for level in range(levels, -1, -1):
        x = ta[level].select("file", "node", F.col("hash").alias("ha"), F.struct("offset", "length").alias("pa"))
        y = tb[level].select("file", "node", F.col("hash").alias("hb"), F.struct("offset", "length").alias("pb"))
        if found is not None:  # only children of nodes that differ are looked at
            up = found.select("file", F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / fanout)).join(up, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.join(y, ["file", "node"], "full_outer")
        found = both.where(~F.col("ha").eqNullSafe(F.col("hb")) | ~F.col("pa").eqNullSafe(F.col("pb")))
    return found.select("file", F.col("node").alias("seq"))


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, seq, other, status: records of ``a`` (place ``seq``) and of ``b`` (place ``other``) at places that differ, aligned by
    record: first those of equal bytes, then those of one key and url in order, then those left alone."""
    places = written(suspects(a, b, fanout), "fixity-places")
    x = a.join(places, ["file", "seq"], "left_semi").select("file", "id", "hash", "seq", "offset")
    y = b.join(places, ["file", "seq"], "left_semi").select("file", "id", "hash", F.col("seq").alias("other"), F.col("offset").alias("at"))
    same = ["file", "id", "hash"]
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(*same).orderBy("seq")))
    y = y.withColumn("k", F.row_number().over(Window.partitionBy(*same).orderBy("other")))
    both = written(x.join(y, [*same, "k"], "full_outer"), "fixity-aligned")
    whole = both.where("seq IS NOT NULL AND other IS NOT NULL")
    status = F.when((F.col("seq") == F.col("other")) & (F.col("offset") == F.col("at")), "ok").otherwise("moved")
    whole = whole.select("file", "seq", "other", status.alias("status"))
    left = both.where("other IS NULL").select("file", "id", "seq").withColumn("k", F.row_number().over(Window.partitionBy("file", "id").orderBy("seq")))
    right = both.where("seq IS NULL").select("file", "id", "other").withColumn("k", F.row_number().over(Window.partitionBy("file", "id").orderBy("other")))
    status = F.when(F.col("other").isNull(), "missing").when(F.col("seq").isNull(), "extra").otherwise("corrupt")
    rest = left.join(right, ["file", "id", "k"], "full_outer").select("file", "seq", "other", status.alias("status"))
    return whole.unionByName(rest)


def fixity(replica_a: DataFrame, replica_b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every record of replica ``a`` (``archived`` rows), and those only ``b`` has: key, file, seq, offset, length,
    hash, status (ok, corrupt, moved, missing or extra)."""
    a, b = written(leaves(replica_a), "fixity-a"), written(leaves(replica_b), "fixity-b")
    found = written(audit(a, b, fanout), "fixity-found")
    extra = b.join(found.where("status = 'extra'").select("file", F.col("other").alias("seq"), "status"), ["file", "seq"])
    rows = a.join(found.where("seq IS NOT NULL").select("file", "seq", "status"), ["file", "seq"], "left").unionByName(extra)
    return rows.select("key", "file", "seq", "offset", "length", "hash", F.coalesce("status", F.lit("ok")).alias("status"))
