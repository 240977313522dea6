"""Item x target matrices, and judge results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scoring import is_critical, judge_blend
from millrace.functions.text import json_in_text
from millrace.session import ship


def targets_of(spark: SparkSession, specs: list[str]) -> DataFrame:
    """target, receptor, box and place of `ID:receptor:box` specifications; exactly three parts each."""
    parts = [s.split(":") for s in specs]
    bad = [s for s, p in zip(specs, parts, strict=True) if len(p) != 3]
    if bad:
        raise ValueError(f"not ID:receptor:box: {bad[0]}")
    return spark.createDataFrame([(*p, k) for k, p in enumerate(parts)], "target string, receptor string, box string, place int")


def result_matrix(items: DataFrame, targets: list[str], run: Callable[[str, str], float | None], prepare: Callable[[str], str | None] | None = None) -> DataFrame:
    """id, smiles, and by target affinity and rank; selectivity: second less first affinity that came out.

    Each item is a row of work that an injected runner does for every target in turn; a failed target leaves empty
    cells. prepare: makes what the runner gets (a conformer with charges, say); items for which it fails or gives
    nothing have no row.
    """
    ship(items.sparkSession)
    columns = "".join(f", `{t}_affinity` double, `{t}_rank` int" for t in targets)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, s in zip(batch["id"], batch["smiles"], strict=True):
                found = []
                try:
                    ready = prepare(s) if prepare else s
                except ImportError:
                    raise
                except Exception:  # noqa: BLE001  the preparation's own errors
                    ready = None
                if ready is None and prepare:
                    continue
                for t in targets:
                    try:
                        found.append(run(ready, t))
                    except ImportError:
                        raise
                    except Exception:  # noqa: BLE001  the runner's own errors
                        found.append(None)
                rows.append([i, s, *(x for a in found for x in (a, None if a is None else 1))])
            names = ["id", "smiles", *(f"{t}_{x}" for t in targets for x in ("affinity", "rank"))]
            out = pd.DataFrame(rows, columns=names).astype({"id": "object", "smiles": "object"})
            for t in targets:
                out[f"{t}_rank"] = out[f"{t}_rank"].astype("Int32")
                out[f"{t}_affinity"] = out[f"{t}_affinity"].astype("float64")
            yield out

    done = items.select("id", "smiles").mapInPandas(work, f"id string, smiles string{columns}")
    return done.withColumn("selectivity", selectivity(*(F.col(f"`{t}_affinity`") for t in targets)))


def outcomes(items: DataFrame, done: DataFrame) -> DataFrame:
    """One row: items that have a row of results, and items that failed."""
    n = items.agg(F.count("*").alias("items")).join(F.broadcast(done.agg(F.count("*").alias("successful"))), how="inner")
    return n.select("successful", (F.col("items") - F.col("successful")).alias("failed"))


def selectivity(*affinities: Column) -> Column:
    came = F.filter(F.array(*affinities), lambda a: a.isNotNull())
    return F.get(came, F.lit(1)) - F.get(came, F.lit(0))


LOGIC = "score double, flag boolean, issues array<string>, assessment string"


def judged(replies: DataFrame, rigor: str = "rigor_reply", logic: str = "logic_reply") -> DataFrame:
    """Blend and critical flag of two judge replies; a reply without readable JSON counts 0.5, unflagged."""
    r, g = json_in_text(rigor, LOGIC), json_in_text(logic, LOGIC)
    out = replies.withColumns({"rigor": F.coalesce(r["score"], F.lit(0.5)), "logic": F.coalesce(g["score"], F.lit(0.5))})
    return out.withColumns({"score": judge_blend("rigor", "logic"), "critical": is_critical("rigor", "logic", r["flag"], g["flag"])})


def difference_text(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """What changed between two molecules' descriptors (mw, logp, hbd, rings), by fixed thresholds."""
    line = lambda name, key, least: F.when(F.abs(after[key] - before[key]) > least, F.concat(F.lit(f"{name}: "), F.format_number(before[key], 2), F.lit(" -> "), F.format_number(after[key], 2)))
    text = F.concat_ws("\n", line("MW", "mw", 1.0), line("logP", "logp", 0.1), line("HBD", "hbd", 0.0), line("Aromatic rings", "rings", 0.0))
    return F.when(text == "", "No structural change").otherwise(text)
