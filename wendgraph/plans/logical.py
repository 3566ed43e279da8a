"""The logical plan of a walk: an anchor, hops, predicates and what is returned."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Below every weight that the compat mode's default lets through.
COMPAT_MIN_WEIGHT = -999999.0


class PlanError(ValueError):
    """The plan names an alias or type that there isn't."""


@dataclass(frozen=True)
class Hop:
    label: str
    weights: tuple[tuple[str, float], ...] = ()  # of the edge: an operator (">=", ">", "=", "<=", "<") and a number
    alias: str = ""
    edge_alias: str = ""
    reverse: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Eq:
    alias: str
    key: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Has:
    alias: str
    key: str
    kind: str | None


@dataclass(frozen=True)
class Return:
    alias: str
    key: str

    @property
    def name(self) -> str:
        return f"{self.alias}.{self.key}"


@dataclass(frozen=True)
class Plan:
    root: str = ""
    hops: tuple[Hop, ...] = ()
    eqs: tuple[Eq, ...] = ()
    has: tuple[Has, ...] = ()
    returns: tuple[Return, ...] = ()
    order: tuple[tuple[Return, bool], ...] = ()  # returned values, and whether downwards
    limit: int | None = None

    def but(self, **changes) -> Plan:
        return replace(self, **changes)

    def bound(self) -> Plan:
        """Checked: there is a root, aliases are different, and everything names one of them."""
        nodes = [self.root, *(h.alias for h in self.hops)]
        edges = [h.edge_alias for h in self.hops if h.edge_alias]
        if not self.root:
            raise PlanError("no match(): a walk needs a root alias")
        known = [a for a in nodes + edges if a]
        if len(set(known)) < len(known):
            raise PlanError("an alias is used twice")
        for x in (*self.eqs, *self.has, *self.returns):
            if x.alias not in known:
                raise PlanError(f"unknown alias {x.alias!r}")
        for x in (*self.eqs, *self.has):
            if x.alias in edges:
                raise PlanError(f"{x.alias!r} is an edge: filter it by weight")
        for r, _ in self.order:
            if r not in self.returns:
                raise PlanError(f"order by {r.name!r}, which isn't returned")
        return self
