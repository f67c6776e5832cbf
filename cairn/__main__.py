"""Command line: python -m cairn --store PATH [--remote PATH] COMMAND ...; --remote names the store of another node."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    from cairn.operators import catalog
    from cairn.operators.lifecycle import Upload, restore, restore_status, upload
    from cairn.operators.retrieve import download, report
    from cairn.plans.protocol import Session
    from cairn.schema import PRODUCT, VERSION
    from cairn.session import session
    from cairn.sources.store import ParquetStore

    parser = argparse.ArgumentParser(prog="cairn", description=__doc__)
    parser.add_argument("--store", default="data")
    parser.add_argument("--remote")
    parser.add_argument("--version", action="version", version=f"{PRODUCT} version {VERSION}")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("upload").add_argument("file")
    get = commands.add_parser("download")
    get.add_argument("file")
    get.add_argument("output")
    get.add_argument("--version", type=int, default=-1, dest="number")
    commands.add_parser("history").add_argument("file")
    back = commands.add_parser("restore")
    back.add_argument("file")
    back.add_argument("number", type=int)
    commands.add_parser("list")
    commands.add_parser("ping").add_argument("message", nargs="?", default="")
    commands.add_parser("stats")
    a = parser.parse_args(argv)
    spark = session()
    node = ParquetStore(spark, a.remote or a.store)
    store = node.load()
    if a.command == "upload":
        if not os.path.isfile(a.file):
            print(f"upload: no such file: {a.file}", file=sys.stderr)
            return 1
        files = spark.read.format("binaryFile").load(a.file).select(F.lit(a.file).alias("name"), F.lit(int(time.time())).cast("bigint").alias("timestamp"), F.col("content").alias("data"))
        if os.path.getsize(a.file) == 0:
            files = spark.createDataFrame([(a.file, int(time.time()), bytearray())], "name string, timestamp bigint, data binary")
        node.commit(upload(store, files))
        catalog.listing(node.load().manifests).filter(F.col("name") == os.path.basename(a.file)).show(truncate=False)
    elif a.command == "download":
        wanted = catalog.resolved(store.manifests, spark.createDataFrame([(a.file, a.number)], "name string, version bigint")).drop("asked")
        row = download(store, wanted).head()
        if row is None:
            report(store, wanted).show(truncate=False)
            return 1
        with open(f"{a.output}.tmp", "wb") as f:
            f.write(row["data"])
        os.replace(f"{a.output}.tmp", a.output)
    elif a.command == "history":
        catalog.history(store.manifests, a.file, gigabytes=bool(a.remote)).show(1000, truncate=False)
    elif a.command == "restore":
        asked = spark.createDataFrame([(a.file, a.number)], "name string, version bigint")
        row = restore_status(store, asked).head()
        print(row["status"])
        if row["status"] != "ok":
            return 1
        new = restore(store, asked, int(time.time()))
        node.commit(Upload(new, store.chunks.limit(0), store.chunks))
    elif a.command == "list":
        catalog.listing(store.manifests, gigabytes=bool(a.remote)).orderBy("name").show(1000, truncate=False)
    elif a.command == "ping":
        print(*Session(spark, store).execute(f"PING {a.message}"))
    else:
        print("stats: not available", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
