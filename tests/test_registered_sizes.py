import inspect

import pytest

from cohortflow.plans import catalog, q_models, q_more  # noqa: F401  (catalog imports in the order that registering needs)


@pytest.mark.parametrize("query, module, name, expected", [
    ("q_e12", "models", "TimeToEvent", {"trees": 500, "depth": 6}),
    ("q_e15", "models", "TimeToEvent", {"trees": 500, "depth": 6}),
    ("q_e10", "evaluate", "downstream", {"trees": True, "tree_count": 300}),
    ("q_d2_fit", "encode", "fit_modes", {"max_iter": 100, "cols": ["age", "mutation_count", "tmb", "fga", "purity", "ploidy", "time"]}),
])
def test_queries_use_the_specified_sizes(monkeypatch, query, module, name, expected):
    plans = q_more if module == "encode" else q_models
    signature = inspect.signature(getattr(getattr(plans, module), name))

    class Asked(Exception):
        pass

    def call(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Asked(bound.arguments)

    monkeypatch.setattr(getattr(plans, module), name, call)
    monkeypatch.setattr(plans, "_tables", lambda *a: (None, None, None))
    with pytest.raises(Asked) as asked:
        getattr(plans, query)(None, "")
    assert {k: asked.value.args[0][k] for k in expected} == expected
