"""Every outcome of the branching operators occurs in the registered queries' results (read off their SQL at sf0.01)."""

import pytest

from gaugeworks.plans import registry
from tools.oracle_check import duck

from conftest import SF_MID

registry.load_all()

OUTCOMES = {
    ("reorder_deliver", "status"): {"delivered", "duplicate", "buffered"},
    ("reorder_deliver", "evicted IS NOT NULL"): {True, False},
    ("fragment_reassembly", "kind"): {"message", "partial_message_timeout", "partial_message_too_large", "closed"},
    ("stream_fragments", "kind"): {"message", "partial_message_timeout", "partial_message_too_large", "closed"},
    ("series_cardinality", "over_limit"): {True, False},
    ("cycle_totals", "overflow"): {True, False},
    ("batch_contiguity", "status"): {"contiguous", "gap", "overlap", "last"},
    ("tier_batch_pinned", "transitioned"): {True, False},
    ("cycle_finalize", "outcome"): {"not_found", "not_open", "lost_race", "duplicate_replay", "finalized"},
    ("storage_meter", "result"): {"ok", "freed", "ttl_expired", "burst_exceeded", "capacity_exceeded"},
    ("stream_rate_limit", "allowed"): {True, False},
    ("stream_replay_guard", "replay"): {True, False},
    ("stream_resync", "kind"): {"transition", "resync_request"},
}


@pytest.fixture(scope="module")
def con():
    return duck(SF_MID)


@pytest.mark.parametrize("name,column", sorted(OUTCOMES))
def test_every_outcome_occurs(con, name, column):
    got = {r[0] for r in con.execute(f"SELECT DISTINCT {column} FROM ({registry.ORACLE[name]})").fetchall()}
    assert got == OUTCOMES[name, column]
