"""The durable catalog: one small event per file, replayed on start.

Events: table, created, created_many, joined, left, dormant, reactivated, dropped, node and
node_dropped (the sets behind subqueries), folded and feeds_folded (aggregate state and feeds of many batches
written as one), and batch (a committed batch with the versions and high-water mark
that it left). The folded state is all that a restart needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from brooklet.sources.fs import Store


@dataclass
class ShapeRecord:
    id: str
    kind: str  # rows or aggregate
    table: str
    where: dict | None
    columns: list[str] | None = None
    changes_only: bool = False
    fn: str | None = None
    col: str | None = None
    since: int = 0
    signature: str = ""
    refs: int = 1
    dormant_at: int | None = None


@dataclass
class Folded:
    shapes: dict[str, ShapeRecord] = field(default_factory=dict)
    batch: int = -1
    version: int = 0
    highwater: tuple[int, int] | None = None
    tables: dict[str, dict] = field(default_factory=dict)
    folded: set[str] = field(default_factory=set)
    gone: set[str] = field(default_factory=set)
    feeds: set[str] = field(default_factory=set)
    feeds_gone: set[str] = field(default_factory=set)
    nodes: dict[str, dict] = field(default_factory=dict)


class Catalog:
    def __init__(self, store: Store):
        self.store = store
        names = store.list("catalog")
        self.next = int(names[-1].split(".")[0]) + 1 if names else 0

    def log(self, event: str, **what) -> None:
        self.store.write_json(f"catalog/{self.next:09d}.json", {"event": event} | what)
        self.next += 1

    def fold(self) -> Folded:
        out = Folded()
        for name in self.store.list("catalog"):
            e = self.store.read_json(f"catalog/{name}")
            match e.pop("event"):
                case "table":
                    out.tables[e["name"]] = e
                case "created":
                    out.shapes[e["id"]] = ShapeRecord(**e)
                case "created_many":
                    out.shapes |= {r["id"]: ShapeRecord(**r) for r in e["shapes"]}
                case "joined":
                    out.shapes[e["id"]].refs += 1
                case "left":
                    out.shapes[e["id"]].refs = max(0, out.shapes[e["id"]].refs - 1)
                case "dormant":
                    out.shapes[e["id"]].dormant_at = e["version"]
                case "reactivated":
                    out.shapes[e["id"]].dormant_at = None
                case "dropped":
                    out.shapes.pop(e["id"], None)
                case "folded":
                    out.folded, out.gone = set(e["new"]), out.gone | set(e["gone"])
                case "feeds_folded":
                    out.feeds, out.feeds_gone = {e["new"]}, out.feeds_gone | set(e["gone"])
                case "node":
                    out.nodes[e["id"]] = e
                case "node_dropped":
                    out.nodes.pop(e["id"], None)
                case "batch":
                    out.batch, out.version = e["batch"], e["version"]
                    out.highwater = tuple(e["highwater"]) if e["highwater"] else None
                    for t, d in e["tables"].items():
                        out.tables[t] |= d
                    for i, d in e.get("nodes", {}).items():
                        out.nodes[i] |= d
        return out
