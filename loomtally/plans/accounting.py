"""The tables of one report, derived lazily from event tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from loomtally.operators import activity as A
from loomtally.operators import aggregate as G
from loomtally.operators import dedup as D
from loomtally.operators import pricing as P
from loomtally.operators import projects, tools
from loomtally.operators import secrets as S
from loomtally.operators.methods import methods_totals
from loomtally.operators.parse import events
from loomtally.options import Options
from loomtally.session import configure, shared_folder
from loomtally.sources import prices as price_source
from loomtally.sources.files import files_of, list_tree, unlisted
from loomtally.sources.lines import read_lines, records, scan_receipts
from loomtally.sources.store import read_store, write_store


class Accounting:
    """Named DataFrames; nothing runs until one of them is read.

    Times limit activity, prompts, calls, refusals and quotas on the event,
    responses after deduplication on their first line, and results only when
    they are orphans. Deduplication figures, workflow counts, cost windows,
    launch folders and the counting methods are never limited.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], files: DataFrame, options: Options | None = None):
        self.spark, self.tables, self.files, self.options = configure(spark), tables, files, options or Options()

    @classmethod
    def scan(
        cls, spark: SparkSession, roots: list[str], options: Options | None = None, now_ms: int | None = None, store: str | None = None
    ) -> Accounting:
        """Reads and parses every line below ``roots`` once, into the folder ``store`` or a new shared one, and opens that."""
        configure(spark)
        path = store or shared_folder(spark, "scan")
        tree = list_tree(spark, roots)
        files = files_of(tree)
        unlisted(tree).write.parquet(f"{path}/unlisted")
        write_store(records(read_lines(spark, files)), files, path)
        return cls.open(spark, path, options, now_ms)

    @classmethod
    def open(cls, spark: SparkSession, store: str, options: Options | None = None, now_ms: int | None = None) -> Accounting:
        """The report of a scan that was kept; no transcript is read again."""
        found, files = read_store(configure(spark), store)
        tables = events(found, files) | {"secret": S.findings(S.spoken_texts(found, files), now_ms)}
        out = cls(spark, tables, files, options)
        out.found, out.store = found, store
        return out

    def _limited(self, name: str) -> DataFrame:
        return D.in_window(self.tables[name], "ts_ms", self.options.since_ms, self.options.until_ms)

    @cached_property
    def prices(self) -> DataFrame:
        return price_source.price_table(self.spark, self.options.price_overrides)

    @cached_property
    def multiplier(self) -> int | None:
        return price_source.multiplier(self.options.price_overrides)

    @cached_property
    def receipts(self) -> DataFrame:
        return scan_receipts(self.found, self.files)

    @cached_property
    def deduped(self) -> DataFrame:
        return D.dedup_responses(self.tables["response"], self.files)

    @cached_property
    def launch(self) -> DataFrame:
        return projects.launch_folders(self.tables["activity"], self.files)

    @cached_property
    def priced(self) -> DataFrame:
        """The responses of the window: deduplicated, priced, with their project.

        Nothing is kept, so that a table that reads it once carries only the columns it needs;
        plans that read it many times call ``keep`` first.
        """
        kept = D.in_window(self.deduped, "ts_start", self.options.since_ms, self.options.until_ms)
        priced = P.price_responses(kept, ["pk", "final_key"], self.prices, self.multiplier)
        return projects.with_project(priced, self.launch, self.options.project_rules)

    def keep(self) -> None:
        """Keeps the priced responses, once worked out, for plans that read them many times."""
        self.priced = self.priced.persist()

    @cached_property
    def activity(self) -> DataFrame:
        return D.by_uuid(self._limited("activity"), self.files, ["ts_ms", "session_id"])

    @cached_property
    def prompts(self) -> DataFrame:
        return D.by_uuid(self._limited("prompt"), self.files, ["ts_ms", "session_id"])

    @cached_property
    def interrupts(self) -> DataFrame:
        return D.by_uuid(self._limited("interrupt"), self.files, ["ts_ms", "session_id"])

    @cached_property
    def calls(self) -> DataFrame:
        return tools.pair(self._limited("tool_use"), self.tables["tool_result"], self.files)

    @cached_property
    def orphans(self) -> DataFrame:
        found = tools.orphan_results(self.tables["tool_result"], self._limited("tool_use"), self.files)
        return D.in_window(found, "ts_ms", self.options.since_ms, self.options.until_ms)

    @cached_property
    def sessions(self) -> DataFrame:
        return A.session_activity(self.activity, self.options.idle_ms)

    @cached_property
    def quota_windows(self) -> DataFrame:
        return D.quota_windows(self._limited("quota"))

    @cached_property
    def refusals(self) -> DataFrame:
        return D.synthetic_429(self._limited("synthetic"))

    @cached_property
    def cost_windows(self) -> DataFrame:
        return D.cost_windows(self.tables["cost_state"], self.files)

    @cached_property
    def stats(self) -> DataFrame:
        return D.dedup_stats(self.deduped)

    @cached_property
    def methods(self) -> DataFrame:
        return methods_totals(self.tables["response"], self.files, self.prices, self.multiplier)

    @cached_property
    def by_project(self) -> DataFrame:
        return G.by_project(self.priced)

    @cached_property
    def secrets(self) -> DataFrame:
        return D.secret_findings(self._limited("secret"), self.files)
