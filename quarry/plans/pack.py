"""Responses that fit a token budget.

Cards are rows. They are rendered and priced by Spark; since every card costs at least one token, a response
can never show more cards than its budget, which bounds what is brought to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def tokens(text: str) -> int:
    return math.ceil(len(text) / T.CHARS_PER_TOKEN * T.SAFETY_MARGIN)


@dataclass
class Part:
    """A titled run of rendered cards: (text, cost) in order, and how many there were in all."""

    title: str
    cards: list[tuple[str, int]] = field(default_factory=list)
    note: str = ""
    total: int = 0


@dataclass
class Pack:
    title: str
    budget: int
    parts: list[Part] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    available: int | None = None

    def _items(self) -> list[tuple[int, str, int, int]]:
        """(part, line, what it adds, what it must find room for) of all parts, flat; notes find room always."""
        flat = []
        for i, p in enumerate(self.parts):
            if p.cards or p.note:
                price = tokens(p.title) + 2
                flat.append((i, p.title, price if p.title else 0, price))
                flat += [(i, text, cost, cost) for text, cost in p.cards]
                if p.note:
                    flat.append((i, f"  {p.note}", tokens(p.note), 0))
        return flat

    def render(self) -> str:
        """What `operators.fitting.fit_answers` does with a table of answers, for one: everything before the first item without room, and the
        note of the part that it ends."""
        title, items = [self.title, ""] if self.title else [], self._items()
        before = accumulate((adds for _, _, adds, _ in items), initial=tokens("\n".join(title)))
        end = next((k for k, (spent, item) in enumerate(zip(before, items, strict=False)) if item[3] and spent + item[3] > self.budget), len(items))
        heads = [k for k in range(len(items)) if k == 0 or items[k][0] != items[k - 1][0]]
        last = items[end][0] if end < len(items) and end not in heads else None  # the part that ends early
        late = [k for k in range(end, len(items)) if items[k][0] == last and not items[k][3]]
        lines, shown = list(title), 0
        for k in [*range(end), *late]:
            if k in heads and k:
                lines.append("")
            lines += [items[k][1]] if k not in heads or items[k][1] else []
            shown += k not in heads and items[k][3] > 0
        short = any(p.total > len(p.cards) for i, p in enumerate(self.parts) if any(items[k][0] == i for k in range(end)))
        whole = sum(p.total for p in self.parts) if self.available is None else self.available
        if shown < whole:
            lines += ["", f"[showing {shown} of {whole}; a larger budget or a closer question shows the rest]"]
        elif end < len(items) or short:
            lines += ["", f"[showing {shown} of {whole}]"]
        elif self.notes and len(items):
            lines.append("")
        return "\n".join([*lines, *(f"[{note}]" for note in self.notes)]).rstrip() + "\n"

    def tokens(self) -> int:
        return tokens(self.render())


def priced(df: DataFrame) -> DataFrame:
    """Adds `card` (rendered text) and `cost`; absent card columns count as empty."""
    have = set(df.columns)
    text = lambda name: F.col(name) if name in have else F.lit("")
    number = lambda name: F.coalesce(F.col(name), F.lit(0)) if name in have else F.lit(0)
    extra = F.col("extra_lines") if "extra_lines" in have else F.array().cast("array<int>")
    at = T.card_location(F.col("path"), number("start_line"), number("end_line"), extra, number("hidden_count"))
    body = F.col("inline_body") if "inline_body" in have else F.lit(None).cast("string")
    card = T.card_text(text("qname"), text("signature"), at, text("reason"), text("placement"), body)
    return df.withColumn("card", card).withColumn("cost", T.estimate_tokens(F.col("card")))


def part(title: str, df: DataFrame, order: list[Column], budget: int, note: str = "", empty: str = "") -> Part:
    """Collect the cards a budget can show and count the rest."""
    rows = priced(df).orderBy(*order).select("card", "cost").limit(budget + 1).collect()
    total = len(rows) if len(rows) <= budget else df.count()
    return Part(title, [(r["card"], r["cost"]) for r in rows], note if rows else empty, total)
