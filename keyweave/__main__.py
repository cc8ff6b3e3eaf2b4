"""Command line: ``python -m keyweave COMMAND PATH ...``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keyweave.model import Status, StatusError
from keyweave.operators import changelog, scan
from keyweave.sources import records, update_logs
from keyweave.table import open_table, restore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyweave")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **flags) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("path")
        for n in names:
            c.add_argument(n)
        for f, kw in flags.items():
            c.add_argument(f"--{f.replace('_', '-')}", **kw)
        c.add_argument("--dbm", default="hash")
        return c

    flag, number = {"action": "store_true"}, {"type": int, "default": 0}
    command("create")
    command("inspect")
    command("get", "key", multi=flag)
    command("set", "key", "value", append={}, incr={"type": int}, keep=flag, reducer={})
    command("remove", "key")
    command("rekey", "old_key", "new_key")
    command("list", move={"default": "first"}, jump_key={"default": ""}, items={"type": int, "default": 10}, keys=flag)
    command("search", "mode", "pattern", capacity=number)
    command("rebuild")
    command("restore", "dest")
    command("merge", "sources", reducer={})
    command("export", "dest", tsv=flag, keys=flag, log=flag)
    command("import", "source", tsv=flag, log=flag)
    queue = command("queue", min_timestamp=number, items=number)
    queue.description = "read the messages of a folder of queue files"
    origin = {"server_id": number, "dbm_index": number}
    for name, names in (("writeset", ("key", "value")), ("writeremove", ("key",)), ("writeclear", ())):
        command(name, *names, timestamp={"type": float}, **origin).description = "append an entry to the update log of a queue"
    every = {"type": int, "default": changelog.EVERYTHING}
    command("readlog", min_timestamp=number, items=number, server_id=every, dbm_index=every).description = "read the entries of a folder of queue files"
    command("listfiles").description = "list the queue files of a folder"
    command("removeoldfiles", "threshold", all=flag).description = "delete the queue files of a folder last written before a time"
    return p


def _write_entry(a) -> None:
    now = time.time() if a.timestamp is None else a.timestamp
    key, value = getattr(a, "key", ""), getattr(a, "value", "")
    with records.QueueWriter(a.path) as w:
        w.write(int(now * 1000), changelog.encode_entry(a.command.removeprefix("write").upper(), a.server_id, a.dbm_index, key.encode(), value.encode()))


def _log_command(spark: SparkSession, a) -> bool:
    """Run a command on update logs; False if it is none."""
    if a.command in ("writeset", "writeremove", "writeclear"):
        _write_entry(a)
    elif a.command == "readlog":
        log = changelog.filter_origin(update_logs.read_log(spark, a.path, a.min_timestamp), a.server_id, a.dbm_index)
        log = log.orderBy("queue_prefix", "seq").select("ts", "server_id", "dbm_index", "op", "key", "value")
        _show(log.limit(a.items) if a.items else log)
    elif a.command == "listfiles":
        _show(update_logs.list_files(spark, a.path).orderBy("queue_prefix", "file_id"))
    elif a.command == "removeoldfiles":
        for f in update_logs.remove_old_files(spark, a.path, int(a.threshold), not a.all):
            print(f)
    else:
        return False
    return True


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if _log_command(spark, a):
        return 0
    if a.command == "queue":
        records.register(spark)
        df = spark.read.format("queuefiles").option("path", a.path).option("min_timestamp", str(a.min_timestamp)).load().orderBy("queue_prefix", "file_id", "file_offset")
        _show(df.limit(a.items) if a.items else df)
        return 0
    t = open_table(spark, a.path, dbm=a.dbm)
    try:
        status = _run(spark, t, a)
    except StatusError as e:
        status = e.status
    if status != Status.SUCCESS:
        print(status, file=sys.stderr)
    return 0 if status == Status.SUCCESS else 1


def _run(spark: SparkSession, t, a) -> Status:
    if a.command == "create":
        t.clear()
    elif a.command == "inspect":
        _show(t.inspect())
    elif a.command == "get":
        keys = a.key.split(",") if a.multi else [a.key]
        held = t.get_multi(keys)
        if a.multi:
            _show(held)
            return Status.SUCCESS
        row = held.head()
        if row is None:
            return Status.NOT_FOUND
        print(row["value"])
    elif a.command == "set":
        if a.append is not None:
            return t.append(a.key, a.value, a.append)
        if a.incr is not None:
            print(t.increment(a.key, int(a.value), a.incr))
            return Status.SUCCESS
        if a.reducer is not None:
            t.insert(spark.createDataFrame([(a.key, a.value, 0)], "key string, value string, seq long"))
            t.synchronize(a.reducer)
            return Status.SUCCESS
        return t.set(a.key, a.value, not a.keep)
    elif a.command == "remove":
        return t.remove(a.key)
    elif a.command == "rekey":
        return t.rekey(a.old_key, a.new_key)
    elif a.command == "list":
        rows = {
            "first": lambda: t.first(a.items),
            "last": lambda: t.last(a.items),
            "jump": lambda: scan.jump(t.df(), a.jump_key, a.items),
            # by their names: upper walks up from the key, lower down
            "jumpupper": lambda: t.range("upper", a.jump_key, a.items),
            "jumplower": lambda: t.range("lower", a.jump_key, a.items),
        }[a.move]()
        _show(rows.select("key") if a.keys else rows.select("key", "value"))
    elif a.command == "search":
        _show(t.search(a.mode, a.pattern, a.capacity).select("key", "value"))
    elif a.command == "rebuild":
        t.rebuild()
    elif a.command == "restore":
        open_table(spark, a.dest, dbm=a.dbm)._replace(restore(spark, a.path))
    elif a.command == "merge":
        sources = [open_table(spark, s, dbm=a.dbm) for s in a.sources.split(",")]
        if a.reducer is None:
            for s in sources:
                s.export(t)
        else:
            t.insert(spark.createDataFrame([], "key string, value string, seq long"))
            t.synchronize(a.reducer, [s.df() for s in sources])
    elif a.command == "export" and a.log:
        with records.QueueWriter(a.dest) as w:
            update_logs.QueueLogger(w)(t.df().select(F.lit("SET").alias("op"), "key", "value"))
    elif a.command == "export":
        t.export_tsv(a.dest) if a.tsv else t.export_key_lines(a.dest) if a.keys else t.export_flat(a.dest)
    elif a.command == "import" and a.log:
        update_logs.apply_log_files(t, a.source)
    elif a.command == "import":
        t.import_tsv(a.source) if a.tsv else t.import_flat(a.source)
    return Status.SUCCESS


def _show(df) -> None:
    shown = df.select(*[F.hex(c).alias(c) if k == "binary" else F.col(c) for c, k in df.dtypes])
    for row in shown.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
