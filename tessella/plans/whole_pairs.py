"""The pair queries over the real part-supplier pairs instead of 40 folded ids, each as whole_NAME."""

from __future__ import annotations

import functools
import inspect

from .queries import ORACLES, QUERIES, WHOLE

_SQL = (("l_suppkey % 40 as a, l_partkey % 40 as b", "l_suppkey * 2 as a, l_partkey * 2 + 1 as b"), ("avg(l_discount) * 10 as score", "round(avg(l_discount) * 10, 9) as score"), (" where l_suppkey % 40 <> l_partkey % 40", ""))

for _name, _f in list(QUERIES.items()):
    if "ids" in inspect.signature(_f).parameters:
        QUERIES[f"whole_{_name}"] = functools.partial(_f, ids=WHOLE)
        if _name in ORACLES:
            ORACLES[f"whole_{_name}"] = functools.reduce(lambda sql, change: sql.replace(*change), _SQL, ORACLES[_name])
