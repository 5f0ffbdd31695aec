"""Command line: mine, topk, profile, and conversion between the two file formats."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallyforge.operators import profile
from tallyforge.plans.significance import mine_significant
from tallyforge.plans.topk import topk_itemsets
from tallyforge.sources import readers, writers


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    p.add_argument("command", choices=("mine", "topk", "profile", "to-sparse", "to-matrix"))
    p.add_argument("--items", required=True, help="matrix or sparse file")
    p.add_argument("--labels", help="label file")
    p.add_argument("--sparse", action="store_true", help="the item file has sparse lines")
    p.add_argument("--test", default="fisher", choices=("fisher", "chi", "u_test"))
    p.add_argument("--alternative", default="greater", choices=("greater", "less", "two.sided"))
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--min-results", type=int, default=0)
    p.add_argument("--max-results", type=int, default=0)
    p.add_argument("-k", type=int, default=3)
    p.add_argument("--all-sets", action="store_true", help="topk: over all sets, not only closed ones")
    p.add_argument("--out", help="folder for converted lines")
    a = p.parse_args(args)
    if a.command in ("mine", "topk") and not a.labels or a.command.startswith("to-") and not a.out:
        p.error("this command needs --labels" if not a.command.startswith("to-") else "this command needs --out")
    spark = SparkSession.builder.getOrCreate()
    data = readers.read_dataset(spark, a.items, a.labels, a.sparse)
    if a.command == "mine":
        found = mine_significant(data, a.test, a.alternative, a.alpha, a.min_results, a.max_results)
        s = found.summary.first()
        print(f"# min. sup={s.min_sup}\tcorrection factor={s.correction_factor}\tlevel={s.sig_level:.6g}")
        for row in writers.result_lines(found.patterns).orderBy("rank").toLocalIterator():
            print(row.value)
    elif a.command == "topk":
        topk_itemsets(data, a.k, a.test, a.alternative, closed=not a.all_sets).orderBy("rank").show(a.k, False)
    elif a.command == "profile":
        profile.summary(data).show(vertical=True)
        profile.reduced_item_counts(data).orderBy("least").show(1 << 30)
    else:
        writers.write_lines(writers.to_sparse(data) if a.command == "to-sparse" else writers.to_matrix(data), a.out)


if __name__ == "__main__":
    main()
