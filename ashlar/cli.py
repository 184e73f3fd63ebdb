"""Command line: python -m ashlar.cli COMMAND FILE [..]; demo writes the example to FILE first."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import tools
from .api import TABLES, Model, open_model
from .example import write_example

COMMANDS = ("demo", "index", "summary", "types", "schema", "extract", "drift", "stats", "cache", "bundle", "clash", "subset", "gltf", "obj", "ask")


def run(model: Model, command: str, rest: list[str], out: str | None, tolerance: float) -> object:
    """Does a command; what is returned is printed as JSON."""
    if command in ("demo", "summary"):
        return model.summary()
    if command == "index":
        return {"products": model.products.count(), "storeys": model.storeys.count(), "schema": model.header["schema"], "unit": model.length_unit}
    if command == "types":
        return tools.types(model)
    if command == "schema":
        return model.schemas()
    if command == "drift":
        return tools.drift(model)
    if command == "ask":
        return json.loads(tools.call(model, rest[0], **dict(x.split("=", 1) for x in rest[1:])))
    if command == "extract":
        for name in rest or TABLES:
            model.table(name).write.mode("overwrite").parquet(f"{out}/{name}")
    elif command == "stats":
        from .operators import reports

        reports.write_csv(model.mesh_stats(), out)
    elif command == "cache":
        return model.write_cache()
    elif command == "bundle":
        model.bundle(out)
    elif command == "clash":
        model.clash(tolerance).write.mode("overwrite").parquet(out)
    elif command == "gltf":
        model.write_gltf(out)
    elif command == "obj":
        model.write_obj(out)
    else:
        model.subset(rest, out)
    return None


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ashlar")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("file")
    p.add_argument("rest", nargs="*")
    p.add_argument("--out")
    p.add_argument("--tolerance", type=float, default=0.0)
    a = p.parse_args(argv)
    if a.command == "demo":
        write_example(a.file)
    spark = SparkSession.builder.appName("ashlar").getOrCreate()
    model = open_model(spark, a.file, cache_dir=a.out if a.command == "cache" else None)
    answer = run(model, a.command, a.rest, a.out, a.tolerance)
    if answer is not None:
        print(json.dumps(answer, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
