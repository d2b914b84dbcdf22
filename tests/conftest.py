"""One small session for all tests, and builders for flows and windows."""

from __future__ import annotations

import os
import sys

import pytest
from builders import flow

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netloom import vocab  # noqa: E402
from netloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_windows(spark):
    """A label spine from a stage list (one session unless sessions are given)."""
    def build(stages, sessions=None):
        sessions = sessions or [0] * len(stages)
        rows = []
        for i, (stage, session) in enumerate(zip(stages, sessions)):
            pos = sum(1 for s in sessions[:i] if s == session)
            remaining = sum(1 for s in sessions[i + 1:] if s == session)
            rows.append(("c", session, f"c#{session}", i, pos, remaining, stage))
        return spark.createDataFrame(
            rows, "capture string, session int, session_key string, window bigint, pos_in_session bigint,"
                  " remaining bigint, stage_now int")
    return build


@pytest.fixture(scope="session")
def make_flows(spark):
    """Canonical flows from partial dicts; unnamed measures are 0 and packet columns NULL."""
    def build(rows):
        types = {"src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "smallint",
                 "label": "string", "family": "string", "stage": "string", "technique": "string",
                 "is_attack": "boolean", "attempted": "boolean"}
        names = (*vocab.KEY_COLUMNS, *vocab.FLOW_COLUMNS, *vocab.PACKET_COLUMNS, *vocab.LABEL_COLUMNS)
        default = {"label": "BENIGN", "family": "Benign", "stage": "Benign", "technique": None, "is_attack": False,
                   "attempted": False}
        data = [tuple(r.get(n, default[n] if n in default else None if n in vocab.PACKET_COLUMNS else 0.0)
                      for n in names) + (r["capture"], r["flow_id"]) for r in rows]
        schema = ", ".join(f"{n} {types.get(n, 'double')}" for n in names) + ", capture string, flow_id bigint"
        return spark.createDataFrame(data, schema)
    return build


@pytest.fixture(scope="session")
def background():
    """Ten hosts talking to twelve servers, about two flows a second."""
    def build(seconds, start=1_000_000, first_id=0):
        return [flow(first_id + i, start + i * 0.5, f"192.168.10.{i % 10 + 1}", f"93.184.0.{i % 12 + 1}")
                for i in range(int(seconds * 2))]
    return build
