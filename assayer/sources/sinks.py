"""Writers: sub-task tables and folders, and the ledger of what was refused."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contracts import validate_gold
from ..operators.subtasks import gold_json
from ..storage import dropped, stored

VERSION = "1"


def checked(subtasks: DataFrame) -> DataFrame:
    """subtasks (id, gold, ...) with violations and valid of their golds."""
    keys = ["id", "violations", "valid"]
    result = validate_gold(subtasks.select("id", F.col("id").alias("directory"), gold_json(F.col("gold")).alias("gold"))).select(keys)
    # written, so that a filter on valid doesn't move below the rules
    return subtasks.join(stored(result, "rules"), "id")


def write_subtasks(subtasks: DataFrame, out: str) -> None:
    """Valid ones to out/tasks; refused ones are appended to out/refused with their first violation."""
    rows = stored(checked(subtasks), "checked")
    rows.where("valid").drop("violations", "valid").write.mode("overwrite").parquet(f"{out}/tasks")
    refused = rows.where(~F.col("valid")).select("id", F.concat(F.lit("gold contract rejected: "), F.col("violations")[0]).alias("reason"))
    refused.write.mode("append").parquet(f"{out}/refused")
    dropped(rows)


def write_folders(subtasks: DataFrame, out: str, meta: list[str] | None = None) -> list[str]:
    """A folder of files for each valid row, written by the driver one row at a time (rows are as many
    as defects). Returns the ids written. YAML is written as its JSON subset."""
    done = []
    meta = [c for c in (meta or ["parent", "parent_defect", "status", "reason", "family"]) if c in subtasks.columns]
    rows = checked(subtasks).where("valid").select("id", "diff", "context", gold_json(F.col("gold")).alias("gold"), *meta).orderBy("id")
    for r in rows.toLocalIterator():
        folder = Path(out) / r["id"]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "diff.patch").write_text(r["diff"])
        (folder / "context.md").write_text(r["context"])
        (folder / "gold.yaml").write_text(json.dumps(json.loads(r["gold"]), indent=2) + "\n")
        said = {c: r[c] for c in meta if r[c]} | {"generator": "assayer", "generator_version": VERSION}
        (folder / "_meta.yaml").write_text(json.dumps(said, indent=2) + "\n")
        done.append(r["id"])
    return done
