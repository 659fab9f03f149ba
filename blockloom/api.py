"""A document session: read-only views, overlay writes, checks, flows and outputs over the tables of one or many documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.audit import checks as C
from blockloom.functions import numbers as N
from blockloom.functions import text as X
from blockloom.functions.geometry import box
from blockloom.operators import aggregates as A
from blockloom.operators import joins as J
from blockloom.operators import sequence as S
from blockloom.operators import translate as T
from blockloom.plans import flows
from blockloom.schema import with_defaults
from blockloom.sources.sinks import OUTPUTS

DOC, PAGE = ["doc_id"], ["doc_id", "page_no"]


@dataclass
class Session:
    """blocks never change; what is written goes to the overlay, an append-only log of (doc_id, block_id, version, action,
    text), and its newest version wins."""

    blocks: DataFrame
    regions: DataFrame | None = None
    lang: str = "English"
    translate: T.Translate = T.echo
    glossary: dict[str, str] = field(default_factory=dict)
    translations: DataFrame | None = None
    overlay: DataFrame | None = None
    version: int = 0
    #: Single edits (doc_id, block_id, version, action, text), which are a part of the overlay as one small table.
    edits: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.blocks = with_defaults(self.blocks)

    # -- views ------------------------------------------------------------------------------------------------

    def pages(self) -> DataFrame:
        return self.blocks.select(*PAGE).distinct()

    def page_kind(self) -> DataFrame:
        vertical = X.is_vertical_label(F.col("text"), *box(), F.col("single_line"), F.col("in_table"))
        pages = self.pages().withColumn("dominant", F.lit(None).cast("string")) if self.regions is None else A.dominant_kind(self.pages(), self.regions, PAGE)
        return A.page_kind(pages, self.blocks.withColumn("vertical", F.coalesce(vertical, F.lit(False))), PAGE)

    def doc_info(self) -> DataFrame:
        return A.document_info(self.page_kind(), self.blocks)

    def structure(self) -> DataFrame:
        if self.regions is None:
            raise ValueError("the session has no regions")
        return J.block_roles(self.blocks, J.claim_regions(self.blocks, self.regions, PAGE), PAGE)

    def page_blocks(self, page: int, offset: int = 0, limit: int = 200) -> DataFrame:
        return self.current().where((F.col("page_no") == page) & (F.col("local_no") >= offset) & (F.col("local_no") < offset + limit))

    def layout_grid(self) -> DataFrame:
        """Texts of each page by row (centres within three points) and from left to right."""
        rows = S.cluster_rows(self.blocks.withColumn("item_no", F.col("block_id")), PAGE, 3.0)
        return rows.groupBy(*PAGE, "row_id").agg(F.array_sort(F.collect_list(F.struct("x0", "item_no", "text"))).alias("r")).select(*PAGE, "row_id", F.col("r.text").alias("texts"))

    def current(self) -> DataFrame:
        """Blocks with target: the overlay, else the translation, else nothing."""
        none = self.blocks.withColumn("target", F.lit(""))
        out = none if self.translations is None else J.with_translation(self.blocks, self.translations, ["doc_id", "block_id"])
        log = self.log()
        return out if log is None else J.overlay_wins(out, J.latest_overlay(log, ["doc_id", "block_id"]), ["doc_id", "block_id"])

    def log(self) -> DataFrame | None:
        """The whole overlay: its table and the single edits."""
        if not self.edits:
            return self.overlay
        own = self.blocks.sparkSession.createDataFrame(self.edits, "doc_id string, block_id int, version long, action string, text string")
        return own if self.overlay is None else self.overlay.unionByName(own)

    # -- writes -----------------------------------------------------------------------------------------------

    def write(self, rows: DataFrame, action: str = "set") -> DataFrame:
        """Adds rows (doc_id, block_id, text) to the overlay. Figures and unknown blocks are refused and returned."""
        known = self.blocks.where(~N.is_numeric_cell(F.col("text"))).select("doc_id", "block_id")
        self.version += 1
        fresh = rows.join(known, ["doc_id", "block_id"], "left_semi").select("doc_id", "block_id", F.lit(self.version).cast("long").alias("version"), F.lit(action).alias("action"), "text")
        self.overlay = fresh if self.overlay is None else self.overlay.unionByName(fresh)
        return rows.join(known, ["doc_id", "block_id"], "left_anti")

    def _edit(self, doc_id: str, block_id: int, action: str, text: str) -> bool:
        """Whether the block is one that may be edited; then the edit counts."""
        own = self.blocks.where((F.col("doc_id") == doc_id) & (F.col("block_id") == block_id) & ~N.is_numeric_cell(F.col("text")))
        if not own.take(1):
            return False
        self.version += 1
        self.edits.append((doc_id, block_id, self.version, action, text))
        return True

    def set_text(self, doc_id: str, block_id: int, text: str) -> bool:
        return self._edit(doc_id, block_id, "set", text)

    def delete_block(self, doc_id: str, block_id: int) -> bool:
        return self._edit(doc_id, block_id, "delete", "")

    def apply_terminology(self, glossary: dict[str, str]) -> None:
        self.glossary |= glossary

    # -- work -------------------------------------------------------------------------------------------------

    def translate_pages(self, pages: list[int] | None = None) -> DataFrame:
        """One job over the page set; blocks that must stay keep their text."""
        todo = self.blocks if pages is None else self.blocks.where(F.col("page_no").isin(pages))
        empty = todo.sparkSession.createDataFrame([], "block_hash string, text string")
        done, _ = T.translate_blocks(todo, empty, self.translate, self.lang, C.protected(F.col("text"), F.col("keep_original")), self.glossary)
        fresh = cut(done.select("doc_id", "block_id", F.col("target").alias("text")))  # the translator is asked once
        new = fresh.withColumnRenamed("text", "_new")
        self.translations = fresh if self.translations is None else cut(self.translations.join(new, ["doc_id", "block_id"], "full").select("doc_id", "block_id", F.coalesce("_new", "text").alias("text")))
        return fresh

    def audit(self, pages: list[int] | None = None, checks: list[str] | str | None = None) -> dict:
        """Findings and a verdict. Pages that don't exist and unknown checks aren't clean."""
        rows = self.current() if pages is None else self.current().where(F.col("page_no").isin(pages))
        names = checks or ["residual", "missing", "numbers", "table"]
        found, unknown = C.audit(rows, PAGE, names, cjk_target(self.lang))
        lost = set(pages or []) - {r.page_no for r in self.pages().where(F.col("page_no").isin(pages or [])).select("page_no").distinct().collect()}
        n = 0 if found is None else found.count()
        return {"findings": found, "issues": n + len(lost), "unknown_checks": unknown, "unknown_pages": sorted(lost), "clean": n == 0 and not lost and not unknown}

    def export(self, output_type: str = "markdown") -> DataFrame:
        return OUTPUTS[output_type](self.pages(), self.current(), DOC)

    def tools(self) -> dict:
        return {"get_doc_info": self.doc_info, "classify_page": self.page_kind, "translate_pages": self.translate_pages, "audit_pages": lambda pages: self.audit(pages), "audit_page": lambda page, checks=None: self.audit([page], checks), "export": self.export, "infer_glossary": lambda: A.latin_terms(self.blocks, DOC)}

    def run_flow(self, name: str, **params) -> flows.Run:
        return flows.execute(flows.FLOWS[name], self.tools(), params=params)


def cut(rows: DataFrame) -> DataFrame:
    """rows, worked out once, where the cluster names a folder for that."""
    return rows.checkpoint() if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows


def cjk_target(lang: str) -> bool:
    """Whether the target language is written in CJK script."""
    t = lang.strip().lower()
    return any(n in t for n in X.CJK_LANGUAGE_NAMES)
