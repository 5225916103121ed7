"""Trace record files and bunch files as Spark data sources.

A trace record is a magic number and a length (32 bits each, in the byte order of the first record) and that many bytes of text tokens, the last of which may be
a block's content in full. A file may end with a decimal line that gives its own offset. Bunch files hold bunches of requests behind a
file header. A file is read by one task, record by record.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the formats.
MAGIC = 0x65617400 | 0x07
VERSION = 0x000100  # 0.1.0
TOKENS = {
    "DFR": ["ptime", "host", "block", "nbytes", "process", "pid", "major", "minor", "data"],
    "CFR": ["ptime", "host", "block", "nbytes", "process", "pid", "major", "minor", "data"],
    "OFR": ["ptime", "host", "block", "nbytes", "process", "pid", "major", "minor"],
    "CFNW": ["ptime", "host", "block", "nbytes", "digest", "content_flag", "process", "pid", "major", "minor", "data"],
    "OFNW": ["ptime", "host", "block", "nbytes", "digest", "content_flag", "process", "pid", "major", "minor", "data"],
    "OFDW": ["ptime", "host", "block", "nbytes", "digest", "content_flag", "process", "pid", "major", "minor", "data"],
    "SFN": ["ptime", "host", "block", "nbytes", "digest", "content_flag", "data"],
    "SFD": ["ptime", "host", "block", "nbytes", "digest", "content_flag", "data"],
    "SZ": ["ptime", "host", "block", "nbytes", "process"],
}
NAME_BYTES = 4096  # a volume's name in a bunch file
HASH_BYTES = 33
NUMBERS = {"ptime", "block", "nbytes", "content_flag", "pid", "major", "minor"}
TRACE_DDL = "seq bigint, file string, event string, ptime bigint, host string, block bigint, nbytes bigint, digest string, content_flag int, process string, pid int, major int, minor int, data binary"
BUNCH_DDL = "seq bigint, file string, bunch bigint, at bigint, host string, block bigint, nbytes bigint, is_read boolean, data binary"


class BadTrace(ValueError):
    pass


def parse_event(body: bytes) -> dict:
    """The fields of a record's text. Process names may hold spaces: they end before the last three numbers of their run."""
    event = body[: body.find(b" ")].decode("ascii", "replace") if b" " in body else body.strip().decode("ascii", "replace")
    names = TOKENS.get(event)
    if names is None:
        raise BadTrace(f"unknown event {event!r}")
    out: dict = {"event": event}
    rest = body[len(event) + 1 :]
    for i, name in enumerate(names):
        if name == "data":
            out["data"] = rest.removesuffix(b"\n")
            break
        if name == "process" and "pid" in names:
            # tokens up to the first that is a number are the name
            parts = []
            while True:
                token, _, after = rest.partition(b" ")
                if token.strip().isdigit() and parts:
                    break
                if not token and not after:
                    raise BadTrace(f"{event} without a process id")
                parts.append(token)
                rest = after
            out[name] = b" ".join(parts).decode("utf-8", "replace")
            continue
        token, _, rest = rest.partition(b" ")
        token = token.strip()
        if not token:
            raise BadTrace(f"{event} without {name}")
        out[name] = int(token) if name in NUMBERS else token.decode("utf-8", "replace")
    return out


def format_event(row: dict) -> bytes:
    names = TOKENS[row["event"]]
    parts = [row["event"].encode()]
    for name in names:
        v = row.get(name)
        parts.append(bytes(v or b"") if name == "data" else str(v if v is not None else (0 if name in NUMBERS else "-")).encode())
    return b" ".join(parts) + b"\n"


def trace_records(f) -> Iterator[dict]:
    """Records of an open file; a short one at the end, or a wrong magic number, is an error."""
    order, at = "<", 0
    while head := f.read(8):
        if at and head.strip().isdigit():
            tail = head + f.read(32)
            if tail.strip().isdigit() and int(tail) == at:
                return
        if len(head) < 8:
            raise BadTrace(f"record cut off at byte {at}")
        if not at and struct.unpack(">I", head[:4])[0] == MAGIC:
            order = ">"
        magic, n = struct.unpack(order + "II", head)
        if magic != MAGIC:
            raise BadTrace(f"no record at byte {at}")
        body = f.read(n)
        if len(body) < n:
            raise BadTrace(f"record cut off at byte {at}")
        out = parse_event(body)
        if out["event"] in ("DFR", "OFNW", "OFDW", "SFN", "SFD") and len(out.get("data") or b"") < out["nbytes"]:
            # the content goes on behind the record's first element, with a line feed at its end
            missing = out["nbytes"] - len(out["data"])
            more = f.read(missing + 1)
            if len(more) <= missing:
                raise BadTrace(f"content cut off at byte {at}")
            out["data"] += more[:missing]
            n += missing + 1
        at += 8 + n
        yield out


def bunch_records(f) -> Iterator[dict]:
    """Requests of an open bunch file."""
    head = f.read(32)
    if not head:
        return
    version, _, bunches, _ = struct.unpack("<4Q", head)
    if version != VERSION:
        raise BadTrace("unknown version of a bunch file")
    for k in range(bunches):
        head = f.read(16)
        if len(head) < 16:
            raise BadTrace("bunch cut off")
        n, at = struct.unpack("<2Q", head)
        for _ in range(n):
            frame = f.read(NAME_BYTES + 12)
            name, (block, nbytes, rw) = frame[:NAME_BYTES].split(b"\0")[0].decode(), struct.unpack("<3I", frame[NAME_BYTES:])
            data = f.read(HASH_BYTES)
            if rw not in (0, 1) or len(data) < HASH_BYTES:
                raise BadTrace("bad request in a bunch")
            yield {"bunch": k, "at": at, "host": name, "block": block, "nbytes": nbytes, "is_read": rw == 1, "data": data[: HASH_BYTES - 1]}


def _files(path: str) -> list[str]:
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    names = sorted(i.path for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [prefix + n if prefix else n for n in names]


class _Part(InputPartition):
    def __init__(self, file: str, number: int):
        self.file, self.number = file, number


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, records):
        self.fields, self.path, self.records = schema.fieldNames(), options["path"], records
        self.files = _files(self.path)

    def partitions(self):
        return [_Part(f, i) for i, f in enumerate(self.files)] or [_Part("", 0)]

    def read(self, part):
        if not part.file:
            return
        fs, name = pafs.FileSystem.from_uri(part.file) if "://" in part.file else (pafs.LocalFileSystem(), part.file)
        with fs.open_input_stream(name) as f:
            for k, r in enumerate(self.records(f)):
                # files follow each other: the number of a record is unique and ascends over them
                r |= {"seq": part.number << 40 | k, "file": name.rsplit("/", 1)[-1]}
                yield tuple(r.get(x) for x in self.fields)


class TraceSource(DataSource):
    """``spark.read.format("io_trace").load(path)``; ``df.write.format("io_trace").save(folder)`` writes a file a task, in seq order within."""

    @classmethod
    def name(cls) -> str:
        return "io_trace"

    def schema(self) -> str:
        return TRACE_DDL

    def reader(self, schema):
        return _Reader(schema, self.options, trace_records)

    def writer(self, schema, overwrite):
        return TraceWriter(schema, self.options)


class BunchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "io_bunches"

    def schema(self) -> str:
        return BUNCH_DDL

    def reader(self, schema):
        return _Reader(schema, self.options, bunch_records)

    def writer(self, schema, overwrite):
        return BunchWriter(schema, self.options)


class _Done(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


class TraceWriter(DataSourceWriter):
    """Writes records; a file appears under its name only when its task has committed."""

    def __init__(self, schema: StructType, options: dict):
        self.fields, self.path = schema.fieldNames(), options["path"]
        self.big = options.get("bigendian", "false") == "true"

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, rows):
        import uuid

        from pyspark import TaskContext

        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        name = f"{root}/.{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(name) as f:
            for r in rows:
                body = format_event(dict(zip(self.fields, r, strict=True)))
                f.write(struct.pack(">II" if self.big else "<II", MAGIC, len(body)) + body)
        return _Done(name)

    def commit(self, messages):
        fs, _ = self._fs()
        for m in messages:
            if m is not None:
                folder, _, name = m.file.rpartition("/")
                fs.move(m.file, f"{folder}/{name[1:]}.trace")

    def abort(self, messages):
        fs, _ = self._fs()
        for m in messages:
            if m is not None:
                fs.delete_file(m.file)


class BunchWriter(TraceWriter):
    """Writes rows (bunch, at, host, block, nbytes, is_read, data) with the rows of a bunch together: one bunch file a task."""

    def write(self, rows):
        import uuid

        from pyspark import TaskContext

        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        name = f"{root}/.{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        body, held, n, bunches, total, genesis = [], [], None, 0, 0, None

        def close() -> None:
            nonlocal bunches, total
            if held:
                body.append(struct.pack("<2Q", len(held), held[0]["at"]))
                for r in held:
                    host = r["host"].encode()
                    if len(host) >= NAME_BYTES:
                        raise BadTrace("name too long for a bunch file")
                    body.append(host.ljust(NAME_BYTES, b"\0") + struct.pack("<3I", r["block"], r["nbytes"], int(r["is_read"])) + bytes(r["data"] or b"").ljust(HASH_BYTES - 1, b"0")[: HASH_BYTES - 1] + b"\n")
                bunches, total = bunches + 1, total + len(held)
                held.clear()

        with fs.open_output_stream(f"{name}.body") as f:
            for r in rows:
                r = dict(zip(self.fields, r, strict=True))
                if r["bunch"] != n:
                    close()
                    n = r["bunch"]
                genesis = r["at"] if genesis is None else min(genesis, r["at"])
                held.append(r)
                f.write(b"".join(body))
                body.clear()
            close()
            f.write(b"".join(body))
        # the header counts what follows, so it is written last and put in front
        with fs.open_output_stream(name) as f, fs.open_input_stream(f"{name}.body") as g:
            f.write(struct.pack("<4Q", VERSION, genesis or 0, bunches, total))
            while part := g.read(1 << 20):
                f.write(part)
        fs.delete_file(f"{name}.body")
        return _Done(name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)
    spark.dataSource.register(BunchSource)
