"""python -m assayer report RUN... | significance A B RUN... | decompose ROOT OUT | generate TEMPLATE OUT"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    need = {"report": 1, "significance": 3, "decompose": 2, "generate": 2}
    if not args or args[0] not in need or len(args) - 1 < need[args[0]]:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("assayer").getOrCreate()
    what, *rest = args
    if what == "report":
        from .operators.runs import markdown_detail, markdown_table, model_order
        from .sources.runs import rollouts

        rows = rollouts(spark, rest).persist()
        models = [r["model"] for r in model_order(rows).orderBy("place").collect()]
        for which in ("curated", "sub-tasks"):
            print(f"\n### {which}\n\n{markdown_table(rows, which, models)}")
            for m in models:
                print(f"\n### {m} ({which})\n\n{markdown_detail(rows, which, m)}")
    elif what == "significance":
        from .operators.inference import bootstrap, sentence
        from .sources.runs import rollouts

        for r in bootstrap(spark, rollouts(spark, rest[2:]).persist(), rest[0], rest[1]).orderBy("population").collect():
            print(sentence(r))
    else:
        from .operators.subtasks import decompose, generate
        from .sources.sinks import write_folders
        from .sources.tasks import load_tasks, templates

        made = decompose(load_tasks(spark, rest[0])) if what == "decompose" else generate(templates(spark, rest[0]))
        print("\n".join(write_folders(made, rest[1])))
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
