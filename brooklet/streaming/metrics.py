"""Counters and latency histograms of the live engine, and their text exposition."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Upper bounds of the latency buckets, in seconds.
BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


@dataclass
class Histogram:
    counts: list[int] = field(default_factory=lambda: [0] * (len(BOUNDS) + 1))
    total: float = 0.0
    n: int = 0

    def add(self, seconds: float) -> None:
        self.counts[next((i for i, b in enumerate(BOUNDS) if seconds <= b), len(BOUNDS))] += 1
        self.total += seconds
        self.n += 1

    def quantile(self, q: float) -> float | None:
        """The upper bound of the bucket that holds the quantile; None without values."""
        need, seen = q * self.n, 0
        for i, c in enumerate(self.counts):
            seen += c
            if self.n and seen >= need:
                return BOUNDS[i] if i < len(BOUNDS) else float("inf")
        return None


@dataclass
class Metrics:
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("batches", "envelopes", "changed_keys", "shapes_created", "shapes_shared", "flipped_sets", "queries_advanced", "queries_passed_over"), 0))
    batch: Histogram = field(default_factory=Histogram)
    create: Histogram = field(default_factory=Histogram)

    def count(self, name: str, by: int = 1) -> None:
        self.counters[name] += by

    def reset(self) -> None:
        self.__init__()

    def summary(self) -> dict:
        return dict(self.counters) | {f"{n}_{k}": h.quantile(q) for n, h in (("batch", self.batch), ("create", self.create)) for k, q in (("p50", 0.5), ("p99", 0.99))}

    def prometheus(self) -> str:
        lines = []
        for name, v in self.counters.items():
            lines += [f"# TYPE brooklet_{name} counter", f"brooklet_{name} {v}"]
        for name, h in (("batch_seconds", self.batch), ("create_seconds", self.create)):
            lines.append(f"# TYPE brooklet_{name} histogram")
            seen = 0
            for bound, c in zip([*map(str, BOUNDS), "+Inf"], h.counts, strict=True):
                seen += c
                lines.append(f'brooklet_{name}_bucket{{le="{bound}"}} {seen}')
            lines += [f"brooklet_{name}_sum {h.total}", f"brooklet_{name}_count {h.n}"]
        return "\n".join(lines) + "\n"
