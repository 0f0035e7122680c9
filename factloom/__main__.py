"""spark-submit entry: extract a table of pages, look up a run, or verify a chain."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from factloom import engine
from factloom.operators import chain
from factloom.session import get_session
from factloom.sources import store


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("factloom")
    sub = p.add_subparsers(dest="what", required=True)
    x = sub.add_parser("extract", help="pages parquet (page_id, url, html) and a schema file to runs, facts and evidence")
    x.add_argument("pages"), x.add_argument("schema"), x.add_argument("out"), x.add_argument("--mode", default="auto"), x.add_argument("--policy")
    q = sub.add_parser("query", help="the latest runs of an address")
    q.add_argument("runs"), q.add_argument("url"), q.add_argument("--limit", type=int, default=10)
    v = sub.add_parser("verify", help="exit code 0 if every chain holds, else 1")
    v.add_argument("chain"), v.add_argument("fields", nargs="+"), v.add_argument("--id", default="chain_id"), v.add_argument("--seq", default="seq")
    a = p.parse_args(args)
    spark = get_session()
    if a.what == "extract":
        policy = store.TrustedPolicy.load(a.policy)
        schema = policy.schema_for(a.schema) if a.schema in policy.schemas else json.loads(Path(a.schema).read_text())
        pages = spark.read.parquet(a.pages)
        t = engine.extract(pages.filter(policy.allowed(pages["url"])), schema, mode=a.mode)
        for name in ("runs", "facts", "evidence"):
            store.save(getattr(t, name), f"{a.out}/{name}")
        return 0
    if a.what == "query":
        store.by_url(spark.read.parquet(a.runs), a.url, a.limit).show(a.limit, truncate=False)
        return 0
    r = chain.verify(spark.read.parquet(a.chain), a.id, a.seq, a.fields)
    r.show(truncate=False)
    return int(r.filter("NOT ok").count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
