"""Graph schemas: vertex labels and relations between them."""

from __future__ import annotations

from dataclasses import dataclass, field


class SchemaError(ValueError):
    """A label or relation that the schema does not have."""


@dataclass(frozen=True)
class Relation:
    """One edge table: a relation's name between two labels."""

    src: str
    name: str
    dst: str


@dataclass
class GraphSchema:
    """Labels with their columns, and relations; both have numeric ids, by which patterns may name them."""

    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    relations: dict[Relation, dict[str, str]] = field(default_factory=dict)
    label_ids: dict[int, str] = field(default_factory=dict)
    relation_ids: dict[int, str] = field(default_factory=dict)

    @classmethod
    def from_json(cls, data: dict) -> GraphSchema:
        """From `entities` and `relations` with `label`, `columns` and `entity_pairs`."""
        out = cls()
        columns = lambda x: {c["column"]["name"]["name"] if isinstance(c.get("column", {}).get("name"), dict) else c.get("name", str(c)): str(c.get("data_type", "")) for c in x.get("columns", [])}
        for e in data["entities"]:
            out.labels[e["label"]["name"]] = columns(e)
            out.label_ids[e["label"]["id"]] = e["label"]["name"]
        for r in data["relations"]:
            out.relation_ids[r["label"]["id"]] = r["label"]["name"]
            for pair in r["entity_pairs"]:
                # Pairs are bound by label id: a pair's name may be stale
                ends = [out.label_ids.get(pair[x]["id"], pair[x]["name"]) for x in ("src", "dst")]
                out.relations[Relation(ends[0], r["label"]["name"], ends[1])] = columns(r)
        return out

    def to_json(self) -> dict:
        ids, rel_ids = {v: k for k, v in self.label_ids.items()}, {v: k for k, v in self.relation_ids.items()}
        for k, name in enumerate(self.labels):
            ids.setdefault(name, k)
        names = list(dict.fromkeys(r.name for r in self.relations))
        for k, name in enumerate(names):
            rel_ids.setdefault(name, k)
        col = lambda cs: [{"name": n, "data_type": t} for n, t in cs.items()]
        label = lambda n: {"id": ids[n], "name": n}
        return {
            "entities": [{"label": label(n), "columns": col(cs)} for n, cs in self.labels.items()],
            "relations": [
                {"label": {"id": rel_ids[n], "name": n}, "columns": col(next(c for r, c in self.relations.items() if r.name == n)), "entity_pairs": [{"src": label(r.src), "dst": label(r.dst)} for r in self.relations if r.name == n]}
                for n in names
            ],
        }

    def label(self, key: int | str) -> str:
        name = self.label_ids.get(key) if isinstance(key, int) else key
        if name not in self.labels:
            raise SchemaError(f"no label {key!r}")
        return name

    def matching(self, names=None, src=None, dst=None) -> list[Relation]:
        """Relations with one of the names (all if None) between the labels (any if None)."""
        if isinstance(names, (str, int)):
            names = [names]
        wanted = None if names is None else {self.relation_ids.get(n, n) if isinstance(n, int) else n for n in names}
        found = [r for r in self.relations if (wanted is None or r.name in wanted) and (src is None or r.src in src) and (dst is None or r.dst in dst)]
        known = {r.name for r in self.relations}
        if wanted and wanted - known:
            raise SchemaError(f"no relation {sorted(map(str, wanted - known))}")
        return found

    def inferred(self, labels: dict, edges: list[tuple]) -> dict:
        """Possible labels of pattern vertices: `labels` maps a vertex to its label or None, `edges` are (src, dst, relation name or None).

        What no relation allows is removed until nothing changes; an empty set is an error.
        """
        found = {v: {self.label(x)} if x is not None else set(self.labels) for v, x in labels.items()}
        changed = True
        while changed:
            changed = False
            for s, d, name in edges:
                fit = self.matching(name, found[s], found[d])
                for v, ends in ((s, {r.src for r in fit}), (d, {r.dst for r in fit})):
                    if found[v] - ends:
                        found[v], changed = found[v] & ends, True
        if bad := [v for v, x in found.items() if not x]:
            raise SchemaError(f"no label fits vertex {bad[0]!r}")
        return found
