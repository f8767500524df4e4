"""Document processors, format extractors, hook points, custom sources.

A processor is a named `DataFrame -> DataFrame` step with an optional row
condition; an extractor contributes typed columns for one format. All of it
composes into one plan (`df.transform`), so a chain of processors is still
one scan and Catalyst sees every expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio import constants as C
from folio.functions.text import file_extension


@dataclass
class Processor:
    """`columns` maps an output column to an expression; rows failing
    `condition` keep their old value (null for a new column)."""
    name: str
    columns: dict[str, Callable[[], Column]]
    condition: Callable[[], Column] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        cond = self.condition() if self.condition else None
        out = {}
        for col, make in self.columns.items():
            e = make()
            if cond is not None:
                old = F.col(col) if col in df.columns else F.lit(None)
                e = F.when(cond, e).otherwise(old)
            out[col] = e
        return df.withColumns(out)


def run_processors(df: DataFrame, processors) -> DataFrame:
    """Apply the processors in order (one projection each, fused by Catalyst)."""
    for p in processors:
        df = df.transform(p)
    return df


@dataclass
class ExtractorRegistry:
    """Extension -> (format, column extractor). Extractors return a dict
    of columns; `apply` folds all formats into one projection keyed by the
    detected format, so every row is read once whatever its format."""
    entries: dict[str, tuple[str, Callable[[], dict[str, Column]]]] = field(default_factory=dict)

    def register(self, extension: str, fmt: str, extractor: Callable[[], dict[str, Column]]):
        self.entries[("." + extension.lstrip(".")).lower()] = (fmt, extractor)
        return self

    def format_column(self, path: Column) -> Column:
        mapping = {k: v for k, v in C.EXTENSION_FORMATS.items()}
        mapping.update({k: v[0] for k, v in self.entries.items()})
        m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.element_at(m, file_extension(path)), F.lit("unknown"))

    def apply(self, df: DataFrame, path_col: str = "path") -> DataFrame:
        return self.extend(df.withColumn("format", self.format_column(F.col(path_col))))

    def extend(self, df: DataFrame) -> DataFrame:
        """The extractors' columns for rows of their formats; a column that is there already stays for other rows."""
        cols: dict[str, Column] = {}
        for ext, (fmt, extractor) in sorted(self.entries.items()):
            for name, e in extractor().items():
                branch = F.when(F.col("format") == fmt, e)
                cols[name] = branch if name not in cols else F.coalesce(cols[name], branch)
        cols = {name: F.coalesce(c, F.col(name)) if name in df.columns else c for name, c in cols.items()}
        return df.withColumns(cols) if cols else df


HOOK_STAGES = ("before_scan", "after_scan", "before_index", "after_index", "before_store",
               "after_store", "before_delete", "after_delete", "before_search", "after_search",
               "modify_results")


@dataclass
class Hooks:
    """Processors attached to named stages. A handler that fails while
    the plan is built (unknown column, bad type) is skipped and reported;
    failures inside tasks cannot be skipped per row and surface as errors."""
    handlers: dict[str, list] = field(default_factory=dict)
    skipped: list[tuple[str, str, str]] = field(default_factory=list)

    def on(self, stage: str, handler):
        if stage not in HOOK_STAGES:
            raise ValueError(f"unknown stage {stage}")
        self.handlers.setdefault(stage, []).append(handler)
        return self

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        for h in self.handlers.get(stage, []):
            try:
                out = df.transform(h)
                out.schema  # analysis happens here, still without running a job
                df = out
            except Exception as e:  # noqa: BLE001 - reported, not raised
                self.skipped.append((stage, getattr(h, "name", getattr(h, "__name__", "handler")), str(e)[:200]))
        return df


# --------------------------------------------------------------------------- U4
def register_sources(spark) -> None:
    """Register the U4 data source (sources/folders.py) with a session."""
    from folio.sources.folders import MarkdownFolder
    spark.dataSource.register(MarkdownFolder)
