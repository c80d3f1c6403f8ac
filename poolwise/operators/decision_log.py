"""Given logs of rolling decisions: their chain, the recorded plan's valid prefix, minimum holds.

A decision row has chain_id, decision_index from 0, cutoff_seconds, observation_fingerprint, candidate_action_ids as
comma-separated text and selected_action_id. Nothing here decides or places anything; logs are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import EPSILON
from ..session import cut_lineage

CHAIN = "chain_id"
FIELDS = ("decision_index", "cutoff_seconds", "observation_fingerprint", "candidate_action_ids", "selected_action_id")
BLOCK = 512


def canonical_row(fields: Sequence[str]) -> Column:
    """The row as text that differs wherever a field differs: each value with its length, null as a dash."""

    def shown(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.concat(*[part for name in fields for part in (F.lit(f"{name}="), shown(name), F.lit(";"))])


def row_fingerprint(previous: Column, fields: Sequence[str] = FIELDS) -> Column:
    """SHA-256 of the fingerprint before and the row's own text; the first row of a chain has nothing before."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("-")), F.lit("|"), canonical_row(fields)), 256)


def verify_chain(log: DataFrame) -> DataFrame:
    """Per chain: rows, whether all links hold, the first broken index and why.

    A row names the fingerprint before it, so each link is checked by itself: the row's fingerprint against
    its own text, its ``previous_fingerprint`` against the row before, and the index against the row's place.
    The row before is found by index across block edges, so no task holds more than a block of a chain.
    """
    own = row_fingerprint(F.col("previous_fingerprint")) == F.col("decision_fingerprint")
    block = F.floor(F.col("decision_index") / BLOCK)
    # The last row of a block is also the row before the next one.
    edge = log.where(F.col("decision_index") % BLOCK == BLOCK - 1).select(
        CHAIN, "decision_index", F.col("decision_fingerprint"), (block + 1).alias("_block"), F.lit(True).alias("_edge")
    )
    rows = log.select(CHAIN, "decision_index", "decision_fingerprint", "previous_fingerprint", own.alias("_own"), block.alias("_block"))
    both = rows.withColumn("_edge", F.lit(False)).unionByName(edge, allowMissingColumns=True)
    order = Window.partitionBy(CHAIN, "_block").orderBy("decision_index", F.col("_edge").desc(), "decision_fingerprint")
    linked = both.withColumns(
        {"_before": F.lag("decision_fingerprint").over(order), "_index": F.lag("decision_index").over(order)}
    ).where(~F.col("_edge"))
    first = F.col("decision_index") == 0
    placed = F.when(first, F.col("_index").isNull()).otherwise(F.coalesce(F.col("_index") == F.col("decision_index") - 1, F.lit(False)))
    reason = (
        F.when(~placed, "index")
        .when(~F.col("previous_fingerprint").eqNullSafe(F.col("_before")), "previous")
        .when(~F.coalesce(F.col("_own"), F.lit(False)), "fingerprint")
    )
    judged = linked.select(CHAIN, "decision_index", reason.alias("_reason"))
    broken = F.min(F.when(F.col("_reason").isNotNull(), F.struct("decision_index", "_reason")))
    return judged.groupBy(CHAIN).agg(F.count("*").alias("decision_count"), broken.alias("_first")).select(
        CHAIN,
        "decision_count",
        F.col("_first").isNull().alias("chain_valid"),
        F.col("_first.decision_index").alias("first_broken_index"),
        F.col("_first._reason").alias("broken_by"),
    )


def replay_plan(observations: DataFrame, plan: DataFrame, catalog: Sequence[str], budget: int, baseline: str) -> DataFrame:
    """Replay recorded choices along each chain and stop at the first cutoff that the plan does not cover.

    ``observations``: chain_id, decision_index, observation_fingerprint; ``plan``: chain_id,
    observation_fingerprint, candidate_action_ids. An entry must hold exactly ``budget`` different actions of the
    catalog, the baseline among them. Returns the observations of the longest valid prefix of each chain with
    their choice, and as ``stopped`` the first observation behind it, without one. A plan that names an observation
    twice is refused as a whole. The prefix is the rows below the least index that fails, one minimum per chain.
    """
    entries = plan.groupBy(CHAIN, "observation_fingerprint").agg(
        F.count("*").alias("_entries"), F.min("candidate_action_ids").alias("candidate_action_ids")
    )
    chosen = F.split("candidate_action_ids", ",")
    allowed = F.array(*[F.lit(a) for a in catalog])
    fits = (
        (F.size(chosen) == budget)
        & (F.size(F.array_distinct(chosen)) == budget)
        & (F.size(F.array_except(chosen, allowed)) == 0)
        & F.array_contains(chosen, baseline)
    )
    refused = entries.groupBy(CHAIN).agg(F.bool_or(F.col("_entries") > 1).alias("_refused"))
    found = (
        observations.select(CHAIN, "decision_index", "observation_fingerprint")
        .join(entries, [CHAIN, "observation_fingerprint"], "left")
        .join(refused, CHAIN, "left")
    )
    reason = (
        F.when(F.col("_refused"), "plan-names-an-observation-twice")
        .when(F.col("_entries").isNull(), "unseen-observation")
        .when(~F.coalesce(fits, F.lit(False)), "choice-outside-budget-or-catalog")
    )
    judged = cut_lineage(found.select(CHAIN, "decision_index", "observation_fingerprint", "candidate_action_ids", reason.alias("stop_reason")))
    stops = judged.where(F.col("stop_reason").isNotNull()).groupBy(CHAIN).agg(F.min("decision_index").alias("_stop"))
    kept = judged.join(stops, CHAIN, "left").where(F.col("_stop").isNull() | (F.col("decision_index") <= F.col("_stop")))
    stopped = F.coalesce(F.col("decision_index") == F.col("_stop"), F.lit(False))
    return kept.select(
        CHAIN,
        "decision_index",
        "observation_fingerprint",
        stopped.alias("stopped"),
        F.when(~stopped, F.col("candidate_action_ids")).alias("candidate_action_ids"),
        F.when(stopped, F.col("stop_reason")).alias("stop_reason"),
    )


HELD = "chain_id string, decision_index long, cutoff_seconds double, action_id string, active_since double, held boolean"
MAPS = "chain_id string, block long, entering string, at double, end_action string, end_since double, stays boolean"
State = tuple[str | None, float | None]


def _settle(state: State, cutoff: float, selected: str, eligible: list[str], hold: float, baseline: str) -> tuple[State, bool]:
    """The state behind a row, and whether the hold refused the row's switch. The baseline has no since."""
    action, since = state
    if selected == baseline:
        if action not in (None, baseline) and cutoff - since < hold - EPSILON and action in eligible:
            return state, True
        return (baseline, None), False
    return (state if action == selected else (selected, cutoff)), False


def _block_map(rows: list[tuple], hold: float, baseline: str) -> list[tuple]:
    """How a block moves a state: rows of (entering action, at, end state, stays), at rising.

    An entering action is left at a row that selects a third one or finds it no longer eligible, whatever its since,
    or at a row that selects the baseline once the hold is over: the earlier it began, the sooner. So the end is
    a step function of since: the first row counts whose hold is over at ``at``. What follows a row that left
    the action does not depend on since. An action that the block never names is left as if none were active.
    """
    n = len(rows)
    behind_baseline: list[State] = [(baseline, None)] * (n + 1)
    behind_select: list[State] = [(None, None)] * n

    def walk(state: State, i: int) -> State:
        while i < n:
            after, _ = _settle(state, *rows[i], hold, baseline)
            if after != state:
                return behind_baseline[i + 1] if after[0] == baseline else behind_select[i]
            i += 1
        return state

    for i in range(n - 1, -1, -1):
        cutoff, selected, _ = rows[i]
        if selected != baseline:
            behind_select[i] = walk((selected, cutoff), i + 1)
            behind_baseline[i] = behind_select[i]
        else:
            behind_baseline[i] = behind_baseline[i + 1]
    out = [(baseline, None, *behind_baseline[0], False)]
    for action in sorted({a for _, selected, eligible in rows for a in (selected, *eligible)} - {baseline}) + [None]:
        steps: list[tuple] = []
        end = None
        for i, (cutoff, selected, eligible) in enumerate(rows):
            if selected not in (baseline, action):
                end = behind_select[i]
            elif selected == baseline and action not in eligible:
                end = behind_baseline[i + 1]
            elif selected == baseline:
                steps.append((cutoff, behind_baseline[i + 1]))
            if end is not None:
                break
        last = None
        for after, state in steps:
            if state != last:
                out.append((action, after, *state, False))
                last = state
            else:
                out[-1] = (action, after, *state, False)
        out.append((action, float("inf"), *(end or (None, None)), end is None))
    return out


def _moved(state: State, moves: dict[str | None, list[tuple]], hold: float) -> State:
    """The state at the end of a block that is entered with ``state``."""
    action, since = state
    for at, end, stays in moves.get(action, moves[None]):
        if at is None or since is None or at - since >= hold - EPSILON:
            return state if stays else end
    return state


def hold_actions(decisions: DataFrame, hold_seconds: float, baseline: str, block: int = BLOCK) -> DataFrame:
    """Keep an action that is not the baseline for at least ``hold_seconds`` against a switch to the baseline.

    ``decisions``: chain_id, decision_index, cutoff_seconds, selected_action_id and ``eligible_action_ids``,
    the actions that passed. A switch to the baseline is refused while the active action is another one, younger
    than the hold and still eligible. Gives action_id, active_since (null for the baseline) and held, where
    the hold refused the switch.

    The state behind a row depends on the one before it, but a block of rows moves states by a small map
    (``_block_map``). The maps are computed apart, one pass over the map rows of a chain in block order finds the
    state that enters each block, and the blocks then walk their own rows. A task holds a block.
    """
    hold = float(hold_seconds)
    packed = decisions.select(
        F.col(CHAIN).cast("string").alias(CHAIN),
        F.floor(F.col("decision_index") / block).alias("block"),
        F.struct(
            F.col("decision_index").cast("long").alias("decision_index"),
            F.col("cutoff_seconds").cast("double").alias("cutoff_seconds"),
            "selected_action_id",
            "eligible_action_ids",
        ).alias("row"),
    )
    blocks = cut_lineage(packed.groupBy(CHAIN, "block").agg(F.array_sort(F.collect_list("row")).alias("rows")))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in _items(batch):
                rows = [(r["cutoff_seconds"], r["selected_action_id"], r["eligible_action_ids"] or []) for r in item["rows"]]
                yield _table(MAPS, [(item[CHAIN], item["block"], *m) for m in _block_map(rows, hold, baseline)])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, moves = None, (None, None), {}
        for batch in batches:
            out = []
            for chain, at_block, entering, at, action, since, stays in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if (chain, at_block) != place:
                    state = _moved(state, moves, hold) if place and place[0] == chain else (None, None)
                    place, moves = (chain, at_block), {}
                    out.append((*place, *state))
                moves.setdefault(entering, []).append((at, (action, since), stays))
            yield _table("chain_id string, block long, action string, since double", out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in _items(batch):
                state, out = (item["action"], item["since"]), []
                for r in item["rows"]:
                    row = (r["cutoff_seconds"], r["selected_action_id"], r["eligible_action_ids"] or [])
                    state, held = _settle(state, *row, hold, baseline)
                    out.append((item[CHAIN], r["decision_index"], r["cutoff_seconds"], *state, held))
                yield _table(HELD, out)

    order = [CHAIN, "block", "entering", F.col("at").asc_nulls_last()]
    ordered = blocks.mapInArrow(maps, MAPS).repartition(CHAIN).sortWithinPartitions(*order)
    entries = ordered.mapInArrow(enter, "chain_id string, block long, action string, since double")
    return blocks.join(entries, [CHAIN, "block"]).select(CHAIN, "rows", "action", "since").mapInArrow(walk, HELD)


def _items(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as Python values, one at a time: a batch holds thousands of blocks."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])
