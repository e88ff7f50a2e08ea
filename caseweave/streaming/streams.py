"""Stream forms of the batch jobs, with Structured Streaming."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseweave.functions.classify import Rules, classify_page
from caseweave.operators.aggregates import status_counts
from caseweave.operators.sequence import page_code, page_features, walk


def stream_classify(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Stateless: new page rows in, predictions out. The text does not go on."""
    return classify_page(pages, rules=rules).drop("text")


def stream_counts(rows: DataFrame, keys: list[str], statuses: list[str], col: str = "status") -> DataFrame:
    """Running counters per key (complete or update mode)."""
    return status_counts(rows, keys, statuses, col)


def stream_correct(pages: DataFrame, text: str = "text") -> DataFrame:
    """Forward-only sequence correction: the state of a file lives in the state store.

    Rows of a micro-batch are walked in page order; the look-ahead rule needs later pages and
    stays with the batch job. Output: file, page_id, rule, type (after correction).
    """
    d = page_features(pages, text).withColumn("code", page_code(F.lit(0))).select("file", "page_id", "page_number", "code")
    kinds = dict(d.dtypes)
    from caseweave.operators.sequence import TYPES

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = walk(False)
        at = int(state.get[0]) if state.exists else w.start
        pdf = pd.concat(list(batches)).sort_values(["page_number", "page_id"])
        rules, kinds_out = [], []
        for c in pdf["code"]:
            out, rule = w.table(int(c))
            prev = int(w.prev[at])
            hit = int(rule[at])
            rules.append(hit)
            kind = prev if hit else int(c) & 7
            kinds_out.append(TYPES[kind - 1] if kind else None)
            at = int(out[at])
        state.update((at,))
        yield pd.DataFrame({"file": pdf["file"], "page_id": pdf["page_id"], "rule": rules, "type": kinds_out})

    schema = f"file {kinds['file']}, page_id {kinds['page_id']}, rule int, type string"
    return d.groupBy("file").applyInPandasWithState(run, schema, "at int", "append", GroupStateTimeout.NoTimeout)
