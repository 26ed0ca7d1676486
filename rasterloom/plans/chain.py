"""A chain of operators on one relation. Runs of table operators become one table and runs of transposes one
transpose before a DataFrame plan is made; palette images stay indices as long as operators allow it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators import color, geometry, point
from ..operators.geometry import TRANSPOSES
from ..relation import BANDS, bands


def compose_tables(first: Sequence[int], second: Sequence[int]) -> list[int]:
    """The table of one after the other."""
    return [second[v] for v in first]


def compose_transposes(first: str | None, second: str) -> str | None:
    """The transpose that does both, None for no change: found by where three corners go."""
    def corners(methods) -> list:
        out = []
        for p in ((0, 0), (2, 0), (0, 1)):
            place = (*p, 3, 2)
            for m in methods:
                place = TRANSPOSES[m](*place) if m else place
            out.append(place)
        return out

    wanted = corners([first, second])
    return next((m for m in [None, *TRANSPOSES] if corners([m]) == wanted))


@dataclass(frozen=True)
class Step:
    """table: a level table; transpose: a method; run: any operator. on_indices: it may see palette indices."""

    table: tuple[int, ...] | None = None
    transpose: str | None = None
    run: Callable[[DataFrame], DataFrame] | None = None
    on_indices: bool = False


@dataclass(frozen=True)
class Chain:
    """Immutable: each method gives a longer chain. Nothing runs before frame() is used by an action."""

    source: DataFrame
    mode: str = "L"
    palette: DataFrame | None = None
    steps: tuple[Step, ...] = ()

    def _with(self, step: Step) -> Chain:
        last = self.steps[-1] if self.steps else Step()
        if step.table and last.table:
            return replace(self, steps=(*self.steps[:-1], Step(table=tuple(compose_tables(last.table, step.table)))))
        if step.transpose and last.transpose:
            both = compose_transposes(last.transpose, step.transpose)
            rest = self.steps[:-1]
            return replace(self, steps=(*rest, Step(transpose=both, on_indices=True)) if both else rest)
        return replace(self, steps=(*self.steps, step))

    def eval(self, fn: Callable[[int], float]) -> Chain:
        return self._with(Step(table=tuple(point.table_of(fn))))

    def invert(self) -> Chain:
        return self.eval(lambda v: 255 - v)

    def posterize(self, bits: int) -> Chain:
        return self.eval(lambda v: v & (256 - (1 << (8 - bits))))

    def solarize(self, threshold: int = 128) -> Chain:
        return self.eval(lambda v: 255 - v if v >= threshold else v)

    def transpose(self, method: str) -> Chain:
        return self._with(Step(transpose=method, on_indices=True))

    def flip(self) -> Chain:
        return self.transpose("FLIP_TOP_BOTTOM")

    def mirror(self) -> Chain:
        return self.transpose("FLIP_LEFT_RIGHT")

    def crop(self, box: Sequence[float]) -> Chain:
        return self._with(Step(run=lambda df: geometry.crop(df, box), on_indices=True))

    def offset(self, dx: int, dy: int) -> Chain:
        return self._with(Step(run=lambda df: geometry.offset(df, dx, dy), on_indices=True))

    def convert(self, mode: str) -> Chain:
        if self.mode == "P":
            expanded = self if self.palette is None else replace(self._with(Step(run=lambda df: color.expand_palette(df, self.palette), on_indices=True)), mode="RGB", palette=None)
            return expanded if mode == "RGB" else expanded.convert(mode)
        source = self.mode
        return replace(self._with(Step(run=lambda df: color.convert(df, source, mode))), mode=mode)

    def apply(self, fn: Callable[..., DataFrame], *args, mode: str | None = None, **options) -> Chain:
        """Any operator of the library, with its arguments after the relation."""
        return replace(self._with(Step(run=lambda df: fn(df, *args, **options))), mode=mode or self.mode)

    def size_bands(self) -> int:
        return BANDS[self.mode]

    def frame(self) -> DataFrame:
        """The DataFrame of the whole chain."""
        df, palette = self.source, self.palette
        for step in self.steps:
            if palette is not None and not step.on_indices:
                df, palette = color.expand_palette(df, palette), None
            if step.table:
                df = point.point(df, step.table)
            elif step.transpose:
                df = geometry.transpose(df, step.transpose)
            else:
                df = step.run(df)
        return df

    def getbands(self) -> list[str]:
        return bands(self.frame())
