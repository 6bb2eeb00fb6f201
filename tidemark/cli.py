"""Commands: python -m tidemark.cli GROUP COMMAND --data DIR [...]. Exit codes: 0 well, 1 a gate or check failed, 2 refused or broken, 3 inconclusive."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import frontier, stats, validate
from tidemark.session import get_spark
from tidemark.sources import store

#: The query that each command shows.
COMMANDS = {
    "eval": {"report": "stat_report", "audit": "leak_audit", "splits": "split_verify", "taxonomy": "agg_taxonomy", "gate": "eval_gate", "golden": None, "power": None},
    "policy": {"gate": "ml_gate", "train": "ml_fit_heads", "decide": "pol_learned_d0", "repair": "ladder_repair_gate", "ablate": "ml_ablation", "fixture": "gen_synth", "runs": None},
    "workers": {"sweep": "sweep_run", "characterize": "ml_characterize", "impute": "agg_impute_report", "validate": "valid_schema", "show": "agg_manifest_counts", "extract": "extract_code", "runs": None},
    "grade": {"run": "grade_run", "one": "grade_one"},
    "corpus": {"build": "corpus_build"},
}


def _show(df: DataFrame, out: str | None) -> list[dict]:
    """Writes a whole result, or prints it, every row of it, a partition at a time."""
    if out:
        df.write.mode("overwrite").parquet(out)
        return []
    rows = []
    for r in df.toLocalIterator():
        rows.append(r.asDict(recursive=True))
        print(json.dumps(store.canonical(rows[-1]), default=str, sort_keys=True))
    return rows


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    groups = p.add_subparsers(dest="group", required=True)
    for g, cs in COMMANDS.items():
        sub = groups.add_parser(g).add_subparsers(dest="command", required=True)
        for c in cs:
            q = sub.add_parser(c)
            q.add_argument("--data", help="folder of tables")
            q.add_argument("--root", help="root of run stores")
            q.add_argument("--out", help="folder to write the result to")
            q.add_argument("--golden", help="a report to compare with")
            q.add_argument("--threshold", type=float, default=0.55)
            q.add_argument("--shares", type=float, nargs=2, default=(0.2, 0.1), help="discordant shares, for power")
            q.add_argument("--tasks", type=int, default=200)
    a = p.parse_args(argv)
    try:
        if (a.group, a.command) == ("eval", "power"):
            need = stats.mcnemar_sample_size(*a.shares)
            print(json.dumps({"needed": need, "tasks": a.tasks, "enough": a.tasks >= need}))
            return 0 if a.tasks >= need else 1
        spark = get_spark("tidemark-cli")
        if a.command == "runs":
            print("\n".join(store.list_runs(spark, a.root)))
            return 0
        from tidemark.plans import problem_queries, replay_queries, rollout_queries

        queries = problem_queries.QUERIES | replay_queries.QUERIES | rollout_queries.QUERIES
        if (a.group, a.command) == ("eval", "golden"):
            now = sorted((json.dumps(store.canonical(r.asDict()), default=str, sort_keys=True) for r in queries["stat_report"](spark, a.data).collect()))
            changes = store.diff(json.loads(store.read_text(spark, a.golden)), now)
            for at, kind in changes:
                print(f"{kind}\t{at}")
            return 1 if changes else 0
        rows = _show(queries[COMMANDS[a.group][a.command]](spark, a.data), a.out)
        if (a.group, a.command) == ("eval", "audit"):
            return 0 if all(r["passed"] for r in rows) else 1
        if (a.group, a.command) in (("eval", "splits"), ("workers", "validate")):
            return 1 if rows else 0
        if (a.group, a.command) == ("policy", "gate"):
            x = queries["stat_boot_auc"](spark, a.data).select(frontier.verdict(F.col("low"), F.col("high"), a.threshold).alias("v")).first()["v"]
            print(x)
            return {"PASS": 0, "FAIL": 1}.get(x, 3)
        if (a.group, a.command) == ("policy", "repair"):
            return 0 if rows and rows[0]["verdict"] == "PASS" else 1
        return 0
    except (validate.Refused, KeyError, ValueError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
