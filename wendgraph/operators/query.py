"""The fluent builder: immutable, lazy, compiled to one DataFrame."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..plans.logical import Eq, Has, Hop, Plan, PlanError, Return

if TYPE_CHECKING:
    from .engine import Engine


class Query:
    """match -> where -> out(...).as_(...) -> ... -> return_. Each call gives a new query."""

    def __init__(self, engine: Engine, plan: Plan = Plan(), where: str = "") -> None:
        self._engine, self.plan, self._last = engine, plan, where

    def _but(self, last: str | None = None, **changes) -> Query:
        return Query(self._engine, self.plan.but(**changes), self._last if last is None else last)

    def match(self, alias: str) -> Query:
        """Names the root; of several calls the last counts."""
        return self._but(root=alias)

    def where_eq(self, alias: str, key: str, value: str) -> Query:
        """The attribute's text equals the value; key "id" is the node's id."""
        return self._but(eqs=(*self.plan.eqs, Eq(alias, key, (str(value),))))

    def where_in(self, alias: str, key: str, values: list[str]) -> Query:
        return self._but(eqs=(*self.plan.eqs, Eq(alias, key, tuple(map(str, values)))))

    def where_has(self, alias: str, key: str, kind: str | None = None) -> Query:
        """The attribute is there, isn't JSON null and has the JSON type, where one is given."""
        return self._but(has=(*self.plan.has, Has(alias, key, kind)))

    def out(self, label: str, min_weight: float | None = 0.0, limit: int | None = None) -> Query:
        """Along edges of a label and at least the weight (None: of any); limit: each node's lightest ones only."""
        weights = () if min_weight is None else ((">=", float(min_weight)),)
        return self._but(hops=(*self.plan.hops, Hop(label, weights, limit=limit)))

    def in_(self, label: str, min_weight: float | None = 0.0, limit: int | None = None) -> Query:
        """Against the edges of a label."""
        q = self.out(label, min_weight, limit)
        return q._hop(reverse=True)

    def where_weight(self, op: str, value: float) -> Query:
        """A further bound on the last hop's weight."""
        if op not in (">=", ">", "=", "<=", "<"):
            raise PlanError(f"unknown comparison {op!r}")
        return self._hop(weights=(*self.plan.hops[-1].weights, (op, float(value))))

    def as_(self, alias: str, edge: str = "") -> Query:
        """Names the node that the last hop led to, and its edge."""
        return self._hop(alias=alias, edge_alias=edge)

    def _hop(self, **changes) -> Query:
        if not self.plan.hops:
            raise PlanError("no hop yet: call out() or in_() first")
        last = self.plan.hops[-1]
        new = Hop(**({k: getattr(last, k) for k in last.__dataclass_fields__} | changes))
        return self._but(hops=(*self.plan.hops[:-1], new))

    def return_(self, alias: str, *keys: str) -> Query:
        """Columns alias.key of the result."""
        return self._but(returns=(*self.plan.returns, *(Return(alias, k) for k in keys)))

    def order_by(self, alias: str, key: str, descending: bool = False) -> Query:
        """Sorts by a returned value; of several calls the first counts most."""
        return self._but(order=(*self.plan.order, (Return(alias, key), descending)))

    def limit(self, n: int) -> Query:
        """The first n rows, in the order asked for."""
        return self._but(limit=n)

    def to_df(self) -> DataFrame:
        return self._engine.compiler().compile(self.plan)

    def counts(self) -> DataFrame:
        """id (native key) of the last node and the number of walks to it."""
        return self._engine.compiler().counts(self.plan)

    def execute(self) -> list[dict]:
        """The rows as dictionaries, on the driver."""
        return self._engine.run(self.to_df())
