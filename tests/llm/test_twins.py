"""Queries against their SQL twins on the small tables."""

import pytest

pytest.importorskip("feedback_points.llm")

from feedback_points.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(name, same_rows):
    same_rows(QUERIES[name], ORACLE[name])
