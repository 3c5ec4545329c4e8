"""Archive files in the public ZIM format as a Spark data source, and a small writer.

``spark.read.format("zim").option("path", ...).load()`` gives one row for each directory
entry.  The directory is cut into runs of entries, one for each task, so a large
archive is read in parallel; a task keeps the last few unpacked clusters.

Filters on entry_id, namespace and path are pushed into the source (``read_zim`` turns on
``spark.sql.python.filterPushdown.enabled``): ids are ranges of the directory, and as it is sorted
by namespace and path, equality and prefixes are found by halving it.  Clusters are
unpacked only where ``content`` is among the columns that are read.  A damaged entry
is a row with ``error``, and without what could not be read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid as uuids
from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

# Fixed values of the format.
MAGIC = 72173914
REDIRECT, LINK_TARGET, DELETED = 0xFFFF, 0xFFFE, 0xFFFD
HEADER = struct.Struct("<IHH16sIIQQQQIIQ")
SCHEMA = "archive string, entry_id long, namespace string, path string, title string, mimetype string, is_redirect boolean, redirect_id long, content binary, error string"


class ZimFile:
    """Random access to one archive over a seekable file."""

    def __init__(self, handle):
        self.f = handle
        head = HEADER.unpack(self._at(0, HEADER.size))
        if head[0] != MAGIC:
            raise ValueError("not a ZIM archive")
        (_, self.major, self.minor, self.uuid, self.entries, self.clusters, self.paths, _, self.cluster_table, mimes, self.main, _, self.checksum) = head
        self.mimes, self._kept, self.counts = [], OrderedDict(), Counter()
        raw, at = b"", mimes
        while b"\0\0" not in raw and len(raw) < 1 << 20:
            more = self._at(at + len(raw), 1024)
            if not more:
                break
            raw += more
        for name in raw.split(b"\0"):
            if not name:
                break
            self.mimes.append(name.decode())

    def _at(self, offset: int, size: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(size)

    def place(self, key: tuple[str, str], low: int, high: int) -> int:
        """The first entry of [low, high) whose (namespace, path) is at or behind ``key``; entries that cannot be read are passed over."""
        wanted = tuple(x.encode() for x in key)
        while low < high:
            mid = at = (low + high) // 2
            own = None
            while at < high and own is None:
                try:
                    e = self.entry(at)
                    own = (e["namespace"].encode(), e["path"].encode())
                except (ValueError, IndexError, struct.error):
                    at += 1
            if own is None or own >= wanted:
                high = mid
            else:
                low = at + 1
        return low

    def entry(self, i: int) -> dict:
        self.counts["entries"] += 1
        at = struct.unpack("<Q", self._at(self.paths + 8 * i, 8))[0]
        raw = self._at(at, 2048)
        kind, _, ns, _ = struct.unpack_from("<HBcI", raw)
        start = 12 if kind == REDIRECT else 16 if kind not in (LINK_TARGET, DELETED) else 8
        while raw.count(b"\0", start) < 2:
            more = self._at(at + len(raw), 2048)
            if not more:
                raise ValueError("a directory entry is cut off")
            raw += more
        path, title = raw[start:].split(b"\0", 2)[:2]
        out = {"entry_id": i, "namespace": ns.decode(), "path": path.decode(), "title": (title or path).decode(), "mimetype": None, "is_redirect": kind == REDIRECT, "redirect_id": None, "cluster": None, "blob": None}
        if kind == REDIRECT:
            out["redirect_id"] = struct.unpack_from("<I", raw, 8)[0]
        elif kind not in (LINK_TARGET, DELETED):
            out["mimetype"] = self.mimes[kind]
            out["cluster"], out["blob"] = struct.unpack_from("<II", raw, 8)
        return out

    def _cluster(self, i: int) -> tuple[bytes, int]:
        if i in self._kept:
            self._kept.move_to_end(i)
            return self._kept[i]
        self.counts["clusters"] += 1
        start = struct.unpack("<Q", self._at(self.cluster_table + 8 * i, 8))[0]
        end = struct.unpack("<Q", self._at(self.cluster_table + 8 * (i + 1), 8))[0] if i + 1 < self.clusters else self.checksum
        info, body = self._at(start, 1)[0], self._at(start + 1, end - start - 1)
        packing = info & 15
        if packing == 5:
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        elif packing == 4:
            import lzma

            body = lzma.LZMADecompressor().decompress(body)
        elif packing not in (0, 1):
            raise ValueError(f"clusters packed by method {packing} are not read")
        self._kept[i] = body, 8 if info & 16 else 4
        if len(self._kept) > 4:
            self._kept.popitem(last=False)
        return self._kept[i]

    def blob(self, cluster: int, i: int) -> bytes:
        body, width = self._cluster(cluster)
        a, b = (int.from_bytes(body[width * j : width * (j + 1)], "little") for j in (i, i + 1))
        return body[a:b]


def _open(path: str):
    if "://" in path:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return open(path, "rb")


class _Run(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


Runs = list[tuple[int, int]]


def _both(a: Runs, b: Runs) -> Runs:
    """What two sorted lists of runs have in common."""
    out = [(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
    return sorted(out)


def _joined(runs: Runs) -> Runs:
    out: Runs = []
    for a, b in sorted(r for r in runs if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_IDS = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, 1 << 62), GreaterThanOrEqual: lambda v: (v, 1 << 62), LessThan: lambda v: (0, v), LessThanOrEqual: lambda v: (0, v + 1)}


def supported(f: Filter) -> bool:
    """Whether the directory answers a filter by itself."""
    name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
    if name == "entry_id":
        return type(f) in _IDS or isinstance(f, In)
    return isinstance(f, (EqualTo, In)) and name in ("namespace", "path") or isinstance(f, StringStartsWith) and name == "path"


def _namespaces(z: ZimFile) -> dict[str, tuple[int, int]]:
    """The run of each namespace, found by halving."""
    out, at = {}, 0
    while at < z.entries:
        try:
            ns = z.entry(at)["namespace"]
        except (ValueError, IndexError, struct.error):
            at += 1
            continue
        end = z.place((chr(ord(ns) + 1), ""), at, z.entries)
        out[ns] = (at, end)
        at = max(end, at + 1)
    return out


def runs_of(z: ZimFile, filters: list[Filter]) -> Runs:
    """The runs of entries that pass supported filters."""
    runs: Runs = [(0, z.entries)]
    spaces = _namespaces(z) if any(f.attribute[0] != "entry_id" for f in filters) else {}
    for f in filters:
        values = list(f.value) if isinstance(f, In) else [f.value]
        if f.attribute[0] == "entry_id":
            one = _IDS[EqualTo if isinstance(f, In) else type(f)]
            found = [one(v) for v in values if v is not None]
        elif f.attribute[0] == "namespace":
            found = [spaces[v] for v in values if v in spaces]
        else:
            found = []
            for ns, (low, high) in spaces.items():
                for v in values:
                    if v is None:
                        continue
                    a = z.place((ns, v), low, high)
                    if isinstance(f, StringStartsWith):
                        found.append((a, z.place((ns, v + "\U0010ffff"), a, high)))
                    elif a < high:
                        b = z.place((ns, v + "\0"), a, high)
                        found.append((a, b))
        runs = _both(runs, _joined(found))
    return runs


class ZimReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.step = options["path"], int(options.get("entriesPerTask", "5000"))
        self.columns = list(schema.names)
        self.filters: list[Filter] = []
        self.counts: Counter = Counter()

    def pushFilters(self, filters):  # noqa: N802
        self.filters = [f for f in filters if supported(f)]
        return [f for f in filters if not supported(f)]

    def partitions(self):
        with _open(self.path) as f:
            z = ZimFile(f)
            runs = runs_of(z, self.filters)
            self.counts = z.counts
        # Short runs, such as single paths, share a task.
        out, size = [[]], 0
        for a, b in runs:
            for c in range(a, b, self.step):
                run = (c, min(b, c + self.step))
                if size and size + run[1] - run[0] > self.step:
                    out.append([])
                    size = 0
                out[-1].append(run)
                size += run[1] - run[0]
        return [_Run(part, None) for part in out]

    def read(self, partition: _Run) -> Iterator[tuple]:
        with _open(self.path) as f:
            z = ZimFile(f)
            found = []
            for first, end in partition.first:
                for i in range(first, end):
                    try:
                        found.append(z.entry(i) | {"error": None})
                    except (ValueError, IndexError, struct.error) as e:
                        found.append(dict.fromkeys(("namespace", "path", "title", "mimetype", "is_redirect", "redirect_id", "cluster", "blob")) | {"entry_id": i, "error": f"{type(e).__name__}: {e}"})
            unpack = "content" in self.columns
            for e in sorted(found, key=lambda e: (e["cluster"] if unpack and e["cluster"] is not None else -1, e["entry_id"])):
                e |= {"archive": self.path, "content": None}
                if unpack and e["cluster"] is not None:
                    try:
                        e["content"] = z.blob(e["cluster"], e["blob"])
                    except Exception as x:  # whatever an unpacker raises
                        e["error"] = f"{type(x).__name__}: {x}"
                yield tuple(e[c] for c in self.columns)
            self.counts = z.counts


class ZimSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZimReader:
        return ZimReader(self.options, schema)


def _load(spark: SparkSession, path: str, entries_per_task: int, columns: list[str] | None) -> DataFrame:
    spark.dataSource.register(ZimSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    reader = spark.read.format("zim").option("path", path).option("entriesPerTask", str(entries_per_task))
    return (reader if columns is None else reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))).load()


def read_zim(spark: SparkSession, path: str, entries_per_task: int = 5000, content: bool = True) -> DataFrame:
    """One row for each entry of an archive, with the path its redirect leads to; without ``content`` no cluster is unpacked."""
    names = [c.split()[0] for c in SCHEMA.split(", ") if content or not c.startswith("content ")]
    e = _load(spark, path, entries_per_task, names)
    to = _load(spark, path, entries_per_task, ["entry_id", "path"]).select(F.col("entry_id").alias("redirect_id"), F.col("path").alias("redirect_to"))
    return e.join(to, "redirect_id", "left").select(*e.columns, "redirect_to")


def projected_totals(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """namespace, sampled, projected, exact: entries of each namespace, counted in archives of at most ``most`` entries.

    Of larger ones ``most`` entries spread by a hash are read, and a total is int(sampled / share), at least what was seen.
    Every namespace is found by halving the directory, so a rare one that the sample misses counts 1.
    """
    with _open(path) as f:
        z = ZimFile(f)
        n, spaces = z.entries, sorted(_namespaces(z))
    exact = n <= most
    rows = _load(spark, path, most, ["entry_id", "namespace", "error"]).where("error is null")
    if not exact:
        step = n / most
        ids = sorted({int(i * step + hashlib.blake2b(str(i).encode(), digest_size=4).digest()[0] / 256 * step) for i in range(most)})
        rows = rows.where(F.col("entry_id").isin(ids))
    share = 1.0 if exact else len(ids) / n
    seen = rows.groupBy("namespace").agg(F.count("*").alias("sampled"))
    known = spark.createDataFrame([(ns,) for ns in spaces], "namespace string")
    out = known.join(seen, "namespace", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    return out.select("namespace", "sampled", F.greatest(F.floor(F.col("sampled") / F.lit(share)), F.col("sampled"), F.lit(1)).cast("long").alias("projected"), F.lit(exact).alias("exact"))


LISTED = "path string, length long, modified timestamp, ord int, real string, readable boolean, warning string"


def list_archives(spark: SparkSession, folder: str | list[str], name: str | None = None) -> DataFrame:
    """path, length, modified, readable, warning of all ``*.zim`` under one or more folders; only the signature of a file is read.

    A link that leads out of its folder is left out.  A file that several folders hold is
    listed once, by the first of them.
    """
    folders = [folder] if isinstance(folder, str) else folder
    files = None
    for i, f in enumerate(folders):
        # The content is not selected, so it is not read.
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zim").load(f)
        one = one.select("path", "length", F.col("modificationTime").alias("modified"), F.lit(i).alias("ord"))
        files = one if files is None else files.unionByName(one)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_signature(p, folders[i]) for p, i in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array([r is not None for r in rows])
            rows = [r for r in rows if r is not None]
            kept = batch.filter(keep)
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [c.split()[0] for c in LISTED.split(", ")])

    out = files.mapInArrow(look, LISTED)
    best = F.min(F.struct("ord", "path", "length", "modified", "readable", "warning")).alias("b")
    out = out.groupBy("real").agg(best).select("b.path", "b.length", "b.modified", "b.readable", "b.warning")
    return out if name is None else out.where(F.contains(F.lower("path"), F.lit(name.lower())))


def _signature(path: str, folder: str) -> tuple[str, bool, str | None] | None:
    """(real path, readable, warning) of a file, or None if it leads out of its folder."""
    local = lambda p: re.sub("^file:/*", "/", p) if p.startswith("file:") else p
    own, real = local(path), local(path)
    if "://" not in own:
        real, root = os.path.realpath(own), os.path.realpath(local(folder))
        if os.path.commonpath([real, root]) != root:
            return None
    try:
        with _open(own) as f:
            ok = f.read(4) == struct.pack("<I", MAGIC)
        return real, ok, None if ok else "not an archive"
    except OSError as e:
        return real, False, f"cannot be read: {type(e).__name__}"


def check_archives(archives: DataFrame) -> DataFrame:
    """path, ok, error of each archive of a listing: its checksum, one file a row, spread over the tasks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                ok = error = None
                try:
                    ok = check_integrity(re.sub("^file:/*", "/", p) if p.startswith("file:") else p)
                except (OSError, ValueError, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"path": p, "ok": bool(ok), "error": error}], pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("error", pa.string())]))

    return archives.select("path").repartition("path").mapInArrow(check, "path string, ok boolean, error string")


def check_integrity(path: str) -> bool:
    """Whether the MD5 at the end of an archive is that of what stands before it."""
    with _open(path) as f:
        z, digest, at = ZimFile(f), hashlib.md5(), 0
        f.seek(0)
        while at < z.checksum:
            part = f.read(min(1 << 20, z.checksum - at))
            if not part:
                return False
            digest.update(part)
            at += len(part)
        return f.read(16) == digest.digest()


def zim_bytes(entries: list[tuple[str, str, str, str | None, bytes | int]], main: int = 0, zstd: bool = True, name: str = "", cluster_bytes: int = 1 << 20) -> bytes:
    """An archive of (namespace, path, title, mimetype, content or index of the redirect's target); entries are put in the directory's order."""
    order = sorted(range(len(entries)), key=lambda i: (entries[i][0].encode(), entries[i][1].encode()))
    place = {old: new for new, old in enumerate(order)}
    main, entries = place.get(main, 0), [entries[i] for i in order]
    mimes = sorted({e[3] for e in entries if e[3]})
    clusters: list[list[bytes]] = [[]]
    where = []
    for e in entries:
        if e[3]:
            if clusters[-1] and sum(map(len, clusters[-1])) + len(e[4]) > cluster_bytes:
                clusters.append([])
            where.append((len(clusters) - 1, len(clusters[-1])))
            clusters[-1].append(e[4])
        else:
            where.append(None)
    packed = []
    for blobs in clusters:
        table, at = b"", 4 * (len(blobs) + 1)
        for b in [*blobs, b""]:
            table += struct.pack("<I", at)
            at += len(b)
        body = table + b"".join(blobs)
        if zstd:
            import zstandard

            body = zstandard.ZstdCompressor().compress(body)
        packed.append(bytes([5 if zstd else 1]) + body)
    mime_part = b"".join(m.encode() + b"\0" for m in mimes) + b"\0"
    dirents = []
    for (ns, p, t, m, c), at in zip(entries, where):
        names = p.encode() + b"\0" + t.encode() + b"\0"
        if m:
            dirents.append(struct.pack("<HBcIII", mimes.index(m), 0, ns.encode(), 0, *at) + names)
        else:
            dirents.append(struct.pack("<HBcII", REDIRECT, 0, ns.encode(), 0, place[c]) + names)
    mime_at = HEADER.size
    paths_at = mime_at + len(mime_part)
    offsets, pos = [], paths_at + 8 * len(entries)
    for d in dirents:
        offsets.append(pos)
        pos += len(d)
    titles_at, clusters_at = pos, pos + 4 * len(entries)
    starts, pos = [], clusters_at + 8 * len(packed)
    for c in packed:
        starts.append(pos)
        pos += len(c)
    head = HEADER.pack(MAGIC, 6, 1, uuids.uuid5(uuids.NAMESPACE_URL, name).bytes, len(entries), len(packed), paths_at, titles_at, clusters_at, mime_at, main, 0xFFFFFFFF, pos)
    titles = b"".join(struct.pack("<I", i) for i in sorted(range(len(entries)), key=lambda i: (entries[i][0], entries[i][2])))
    data = head + mime_part + b"".join(struct.pack("<Q", o) for o in offsets) + b"".join(dirents) + titles + b"".join(struct.pack("<Q", o) for o in starts) + b"".join(packed)
    return data + hashlib.md5(data).digest()


def _put(path: str, data: bytes) -> None:
    """Writes a file beside its name and then renames it, in whatever file system the path names."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuids.uuid4().hex[:8]}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, name)


def write_zim(path: str, entries: list[tuple[str, str, str, str | None, bytes | int]], main: int = 0, zstd: bool = True) -> None:
    """A small archive in one file."""
    _put(path, zim_bytes(entries, main, zstd, path))


def write_archives(entries: DataFrame, folder: str) -> DataFrame:
    """archive, path, entries, bytes: writes the rows (archive, namespace, path, title, mimetype, redirect_to, content) as ``<folder>/<archive>.zim``.

    Each archive is one file, made in one task, so callers keep archives of a size that a task holds.  Files appear
    under their name only when they are whole; a repeated task writes the same file again.
    """
    scheme = re.compile(r"^file:/+")
    base = scheme.sub("file:///", folder)

    def write(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = rows.to_pylist()
        at = {(r["namespace"], r["path"]): i for i, r in enumerate(found)}
        made = [(r["namespace"], r["path"], r["title"] or r["path"], r["mimetype"], r["content"] or b"") if r["redirect_to"] is None else (r["namespace"], r["path"], r["title"] or r["path"], None, at[r["namespace"], r["redirect_to"]]) for r in found]
        name = key[0].as_py()
        data = zim_bytes(made, name=name)
        _put(f"{base}/{name}.zim", data)
        return pa.table({"archive": [name], "path": [f"{base}/{name}.zim"], "entries": [len(made)], "bytes": [len(data)]})

    rows = entries.select("archive", "namespace", "path", "title", "mimetype", "redirect_to", F.col("content").cast("binary").alias("content"))
    return rows.groupBy("archive").applyInArrow(write, "archive string, path string, entries long, bytes long")


def read_archives(archives: DataFrame, content: bool = True) -> DataFrame:
    """All entries of many archives (rows with ``path``), a task an archive; archives that cannot be opened give one row with ``error``."""
    names = [c.split()[0] for c in SCHEMA.split(", ") if content or not c.startswith("content ")]
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    class Columns:
        pass

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = Columns()
        fields.names = names
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    reader = ZimReader({"path": path, "entriesPerTask": "1000"}, fields)
                    runs = reader.partitions()
                except Exception as e:
                    row = dict.fromkeys(names) | {"archive": path, "error": f"{type(e).__name__}: {e}"}
                    yield pa.RecordBatch.from_pydict({c: pa.array([row[c]], arrow[kinds[c]]) for c in names})
                    continue
                for run in runs:
                    rows = list(reader.read(run))
                    if rows:
                        yield pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in rows], arrow[kinds[c]]) for j, c in enumerate(names)})

    return archives.select("path").repartition("path").mapInArrow(read, schema)
