"""Decision logs: block edges, tampering, holds folded by blocks against a plain walk."""

import hashlib
import random

from pyspark.sql import functions as F

from poolwise.operators import decision_log as dl

BASE = "base"


def plain_hold(rows, hold):
    out, action, since = [], None, None
    for index, cutoff, selected, eligible in rows:
        held = selected == BASE and action not in (None, BASE) and cutoff - since < hold - 1e-9 and action in eligible
        if not held:
            since = None if selected == BASE else since if selected == action else cutoff
            action = selected
        out.append((index, cutoff, action, since, held))
    return out


def test_hold_by_blocks_equals_a_plain_walk(spark):
    rng = random.Random(2)
    rows, want = [], []
    for c in range(12):
        t, chain = 0.0, []
        for i in range(rng.choice([1, 3, 8, 60])):
            t += rng.choice([0.0, 10.0, 50.0, 300.0])
            actions = [BASE] * rng.choice([1, 6]) + ["x", "y"]
            chain.append((i, t, rng.choice(actions), rng.sample(["x", "y", BASE], rng.randint(0, 3))))
        rows += [(f"c{c}", *r) for r in chain]
        want += [(f"c{c}", *r) for r in plain_hold(chain, 120.0)]
    df = spark.createDataFrame(rows, "chain_id string, decision_index long, cutoff_seconds double, selected_action_id string, eligible_action_ids array<string>")
    for block in (1, 2, 5, 512):
        assert sorted(map(tuple, dl.hold_actions(df, 120.0, BASE, block).collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[-1] for r in want) > 20


def chain_rows(n, name="c"):
    rows, previous = [], None
    for i in range(n):
        text = "".join(f"{k}={len(str(v))}:{v};" for k, v in zip(dl.FIELDS, (i, 10 * i, f"o{i}", "a,b", "a"), strict=True))
        own = hashlib.sha256(f"{previous or '-'}|{text}".encode()).hexdigest()
        rows.append([name, i, 10 * i, f"o{i}", "a,b", "a", previous, own])
        previous = own
    return rows


SCHEMA = "chain_id string, decision_index long, cutoff_seconds long, observation_fingerprint string, candidate_action_ids string, selected_action_id string, previous_fingerprint string, decision_fingerprint string"


def test_the_first_broken_link_is_found_at_block_edges(spark):
    n = 2 * dl.BLOCK + 3
    rows, want = [], {}
    for edge in (0, 1, dl.BLOCK - 1, dl.BLOCK, dl.BLOCK + 1, n - 1):
        for kind in ("fingerprint", "previous", "index", None):
            name, own = f"{kind}-{edge}", chain_rows(n, f"{kind}-{edge}")
            if kind == "fingerprint":
                own[edge][5] = "b"
            elif kind == "previous":
                own[edge][6] = "0" * 64
            elif kind == "index":
                del own[edge]
            first = edge + 1 if kind == "index" else edge
            broken = kind is not None and not (kind == "index" and edge == n - 1)
            want[name] = (not broken, first if broken else None, kind if broken else None)
            rows += own
    got = {r.chain_id: (r.chain_valid, r.first_broken_index, r.broken_by) for r in dl.verify_chain(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_a_plan_is_replayed_up_to_the_first_failure(spark):
    log = spark.createDataFrame([(c, i, f"{c}{i}") for c in "abcd" for i in range(5)], "chain_id string, decision_index long, observation_fingerprint string")
    plan = log.withColumn("candidate_action_ids", F.lit("base,x")).drop("decision_index")
    plan = plan.where("observation_fingerprint != 'b2'").withColumn(
        "candidate_action_ids", F.when(F.col("observation_fingerprint") == "c0", "x,y").otherwise(F.col("candidate_action_ids"))
    )
    plan = plan.unionByName(plan.where("observation_fingerprint = 'd4'"))
    got = {}
    for r in dl.replay_plan(log, plan, ["base", "x", "y"], 2, "base").collect():
        got.setdefault(r.chain_id, []).append((r.decision_index, r.candidate_action_ids, r.stop_reason))
    full = [(i, "base,x", None) for i in range(5)]
    assert {c: sorted(v) for c, v in got.items()} == {
        "a": full,
        "b": [*full[:2], (2, None, "unseen-observation")],
        "c": [(0, None, "choice-outside-budget-or-catalog")],
        "d": [(0, None, "plan-names-an-observation-twice")],
    }
