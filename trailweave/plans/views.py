"""The analysis views: scope first, then the operators of each view in their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.paths import scope_prefix, style_prefix, subject_pattern
from trailweave.functions.predicates import SpaceFilter, Stage, all_stages, subject_prefix, text_filter
from trailweave.operators import conformance, counts, relations, space
from trailweave.operators.conformance import Template
from trailweave.operators.discovery import Discovery, discover
from trailweave.operators.machine import Model, check_log, machine_of
from trailweave.operators.variants import variants
from trailweave.session import cut_lineage, small_table

# Fixed value: variants listed in the process view.
TOP_VARIANTS = 8


def scoped(log: DataFrame, scope: Stage | None = None, shared: list[Stage] | None = None, lens: Stage | None = None) -> DataFrame:
    """Base scope, shared stages and the view's own lens, all pushed to the scan."""
    layers = [layer for layer in [scope, *(shared or []), lens] if layer is not None]
    return log.where(all_stages(layers)) if layers else log


@dataclass(frozen=True)
class ProcessView:
    discovery: Discovery
    nodes: DataFrame
    edges: DataFrame
    variants: DataFrame
    totals: DataFrame


def process_view(log: DataFrame, **layers) -> ProcessView:
    """Discovery of the scoped log with its top variants."""
    found = discover(scoped(log, **layers), keep=True)
    return ProcessView(found, found.nodes, found.edges, variants(found, TOP_VARIANTS), found.totals)


@dataclass(frozen=True)
class SpaceView:
    mode: str
    legend: DataFrame
    rows: DataFrame
    marks: DataFrame


def space_view(
    log: DataFrame, scope: Stage | None = None, shared: list[Stage] | None = None, lens: SpaceFilter | None = None,
    frame: str = "", mode: str = "", group: str = "", max_rows: int = space.MAX_ROWS,
    max_dots: int = space.MAX_DOTS, cols: int = space.COLUMNS,
) -> SpaceView:
    """Legend over the scope; then lens, newest events, level of detail, bands, grid."""
    base = scoped(log, scope, shared)
    legend = counts.type_counts(base)
    charted = counts.last_n(base.where(lens.predicate()) if lens else base, counts.frame_size(frame))
    if mode not in ("dots", "density"):
        mode = space.detail(charted, max_rows, max_dots).first()["mode"]
    placed = space.axis(charted)
    if mode == "dots":
        return SpaceView(mode, legend, space.dotted_rows(placed, max_rows), space.dotted_points(placed, max_rows))
    if group == "variant":
        bands, member = space.variant_bands(charted, max_rows)
    else:
        bands, member = space.subject_bands(charted, max_rows), None
    cells = space.density(placed, bands, member, cols)
    return SpaceView(mode, legend, space.density_rows(cells, bands), space.density_view(cells))


@dataclass(frozen=True)
class ModelView:
    fit: DataFrame
    deviations: DataFrame
    coverage: DataFrame
    unused: DataFrame
    unknown: DataFrame


def model_view(log: DataFrame, model: Model, scope: Stage | None = None) -> ModelView:
    """A designed model against the subjects its subject style speaks about."""
    style = small_table(log.sparkSession, [(model.subject_style,)], "style string")
    prefix = style.select(style_prefix(F.col("style"))).first()[0]
    base = scoped(log, scope).where(subject_prefix(prefix))
    checked = cut_lineage(check_log(base, machine_of(log.sparkSession, model), with_edges=True))
    return ModelView(conformance.model_fit(checked), conformance.model_deviations(checked), conformance.edge_coverage(checked, model),
                     conformance.unused_types(base, model), conformance.unknown_types(base, model))


@dataclass(frozen=True)
class TemplateView:
    summary: DataFrame
    coverage: DataFrame
    unexpected: DataFrame
    deviations: DataFrame
    patterns: DataFrame
    presence: DataFrame


def template_view(log: DataFrame, template: Template, scope: Stage | None = None) -> TemplateView:
    """A process template against the subtree it names, or the whole log if that is empty."""
    given = small_table(log.sparkSession, [(template.subject,)], "subject string")
    prefix = given.select(scope_prefix(subject_pattern(F.col("subject")))).first()[0]
    base = counts.scoped_or_all(scoped(log, scope), prefix)
    checked = cut_lineage(conformance.template_check(base, template))
    return TemplateView(
        conformance.template_summary(base, checked), conformance.step_coverage(checked, template),
        conformance.unexpected_types(base, template), conformance.template_deviations(checked),
        conformance.sample_patterns(base), conformance.expected_presence(base, template))


def templates_of(rows: DataFrame) -> list[Template]:
    """Templates from the rows of the template reader: one per document, so a short list."""
    steps = rows.groupBy("template_id", "process", "subject_pattern").agg(
        F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("steps")).orderBy("template_id").collect()
    return [Template(r["process"], tuple(s["type"] for s in r["steps"]), r["subject_pattern"]) for r in steps]


def relations_view(log: DataFrame, scope: Stage | None = None, shared: list[Stage] | None = None):
    """Subject tree and reference graph of the scoped log."""
    base = scoped(log, scope, shared)
    graph = relations.References(base)
    return relations.tree_order(relations.subject_tree(base)), graph.nodes(), graph.edges()


def event_list(log: DataFrame, event_type: str = "", subject: str = "", search: str = "") -> DataFrame:
    """Inspector list with an optional text search over what it shows."""
    listed = counts.inspect(log, event_type, subject)
    return listed.where(text_filter(search)) if search else listed
