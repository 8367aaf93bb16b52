"""What a group of the triage stream holds while its rows are put in order."""

from __future__ import annotations

import numpy as np
import pandas as pd

from hazardflow.streaming import state


def inputs_of(part):
    """Rows as the stream operator gets them, dealt to tables of two rows."""
    return (part.iloc[i : i + 2] for i in range(0, len(part), 2))


def test_group_holds_one_batch_of_model_inputs(monkeypatch):
    """Model inputs wait in a file; those of the scored rows come back by place, and the rest in time order."""
    monkeypatch.setattr(state, "SPOOLED", 1)
    part = pd.DataFrame(
        {
            "key": ["x", "y", "x", None, "y"], "event_id": ["e", "d", "c", "k", "a"], "us": [5, 4, 3, 2, 4],
            "clear": [False, False, False, True, False], "features": [np.full(2, float(i)) for i in range(5)],
            "sequence": [None, np.ones(3), None, None, np.zeros(3)], "estimated_affected_population": range(5),
            "composite_risk_score": 0.5,
        }
    )
    with state._Inputs() as inputs:
        rows, clears, names = inputs.kept(inputs_of(part))
        assert rows["event_id"].tolist() == ["c", "a", "d", "e"] and rows["us"].tolist() == [3, 4, 4, 5]
        assert rows["place"].tolist() == [2, 3, 1, 0] and [names[k] for k in rows["key"]] == ["x", "y", "y", "x"]
        assert clears.tolist() == [2] and "features" not in rows and "sequence" not in rows
        empty, *found = inputs.rows(np.array([0, 3]))
        assert not len(empty) and [len(f) for f in found] == [1, 1]
        assert [f["event_id"][0] for f in found] == ["e", "a"] and found[1]["features"][0].tolist() == [4.0, 4.0]
        assert found[0]["sequence"][0] is None and found[1]["sequence"][0].tolist() == [0.0] * 3
