"""python -m plumbline data --manifest FILE --label COLUMN --text FIELD..., or python -m plumbline system --predictions FILE --equal CONFIG."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.plans import system_audit
from plumbline.plans.audit import AuditSpec, markdown, run_data_tier, to_json
from plumbline.sources.manifest import read_embeddings, read_manifest, read_provenance


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline")
    tiers = parser.add_subparsers(dest="tier", required=True)
    data = tiers.add_parser("data", help="checks that need only the data")
    data.add_argument("--manifest", required=True)
    data.add_argument("--label", required=True)
    data.add_argument("--text", nargs="+", required=True)
    data.add_argument("--split")
    data.add_argument("--source")
    data.add_argument("--provenance")
    data.add_argument("--emb", nargs="*", default=[], metavar="ENCODER:VIEW=path")
    data.add_argument("--nulls", type=int, default=20)
    data.add_argument("--timed", action="store_true", help="run the checks one after the other and report their seconds")
    data.add_argument("--out", default="audit")
    runs = tiers.add_parser("system", help="checks that need predictions: item_id, seed, config, y, pa, pb")
    runs.add_argument("--predictions", required=True)
    runs.add_argument("--equal", required=True, help="the configuration of equal inputs")
    runs.add_argument("--inventory", help="a table of component and input")
    runs.add_argument("--system", nargs="*", default=[])
    runs.add_argument("--baseline", nargs="*", default=[])
    runs.add_argument("--available", nargs="*", default=[])
    runs.add_argument("--influence", help="a table of y, pred_full and pred_without")
    runs.add_argument("--out", default="audit")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if a.tier == "system":
        read = lambda path: (spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)) if path else None
        found = system_audit.run_system_tier(read(a.predictions), a.equal, read(a.inventory), (a.system, a.baseline, a.available), read(a.influence))
        Path(f"{a.out}.json").write_text(system_audit.to_json(found))
        print(f"{a.out}.json written")
        return 0
    manifest = read_manifest(spark, a.manifest)
    spec = AuditSpec(a.label, a.text, a.split, a.source, read_provenance(spark, a.provenance) if a.provenance else None, read_embeddings(spark, a.emb, manifest) if a.emb else None, nulls=a.nulls, timed=a.timed)
    result = run_data_tier(manifest, spec)
    Path(f"{a.out}.json").write_text(to_json(result))
    Path(f"{a.out}.md").write_text(markdown(result))
    print(f"{a.out}.json and {a.out}.md written")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
