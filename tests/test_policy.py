"""Guards on plan-level policies of the library code."""

import pathlib

SRC = pathlib.Path(__file__).resolve().parents[1] / "corpuslab"


def _code():
    return {p.name: p.read_text() for p in SRC.rglob("*.py")}


def test_no_local_checkpoint_cross_join_or_sampling():
    for name, text in _code().items():
        assert "localCheckpoint" not in text, name
        assert "crossJoin" not in text, name
        assert ".sample(" not in text and "sampleBy(" not in text, name
        assert "F.rand(" not in text and "F.randn(" not in text, name  # draws are keyed hashes


def test_limits_only_where_they_are_the_feature():
    allowed = {"sampling.py", "q_stats.py", "q_sampling.py", "stats.py", "tables.py", "runlogs.py"}
    for name, text in _code().items():
        if ".limit(" in text:
            assert name in allowed, name
