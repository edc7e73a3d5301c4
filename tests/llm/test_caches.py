"""What a worker keeps from one operator to the next."""

from __future__ import annotations

from functools import lru_cache

from silvergrain.llm import shared


def test_a_worker_keeps_the_caches_of_one_operator():
    made = []

    @lru_cache
    def first(x):
        made.append(x)
        return x

    @lru_cache
    def second(x):
        return x

    shared.sole(first)
    first(1)
    shared.sole(first)
    first(1)
    assert made == [1]  # the same operator's stay from task to task
    shared.sole(second)
    shared.sole(first)
    first(1)
    assert made == [1, 1]
    shared.sole()
    assert first.cache_info().currsize == 0
