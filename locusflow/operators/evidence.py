"""Locus- and gene-keyed evidence joins with explicit unknown, absent and filtered states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions.consequences import literal_map
from locusflow.functions.info import carried_annotation
from locusflow.functions.keys import LOCUS, locus_from_key, with_locus
from locusflow.operators.intervals import flag_inside
from locusflow.operators.skew import FAN_OUT, HEAVY_FLOOR, SPREAD, attach, counted_heavy_hashes, heavy_rows, spread_number
from locusflow.settings import CURATED_INHERITANCE, GENOME_BUILD

SPREAD_ON = ["sample_id", "line_no"]
JOIN_ALT = "_join_alt"
OWN_COLUMNS = [*LOCUS, SPREAD, JOIN_ALT]
#: Calls of one join task, from MANY_CALLS on. Their shuffle compresses well, so tasks put together by
#: compressed size would sort more calls than fit their memory.
CALLS_A_TASK, MANY_CALLS = 250_000, 4_000_000


@dataclass(frozen=True)
class Coverage:
    """What a frequency store vouches for: ``full``, ``bed`` or ``partial``.

    Only a covered contig of a full store, or a covered position of a BED store, may
    turn a missing row into an absence.
    """

    mode: str = "partial"
    contigs: tuple[str, ...] = ()
    regions: DataFrame | None = None

    @property
    def effective_mode(self) -> str:
        return "partial" if self.mode == "bed" and self.regions is None else self.mode


class LocusJoins:
    """Left joins of calls to several locus-keyed stores over one shared partitioning.

    All joins use the same four columns, so they reuse one exchange of the calls. Loci
    carried by a large share of all calls are found by a sketch of ``counted`` (the calls
    themselves, or rows with the same loci that are cheaper to read). Their calls keep their
    locus but join under an alternative allele that no store has and that differs by row, so
    they are dealt evenly; their values come from broadcast store rows, one per heavy locus.
    No store row is repeated, so a store laid out by locus is joined where it lies. Stores are
    merged, not broadcast: their file size says little about their rows. From ``many`` calls on the
    number of join tasks follows from the number of calls.
    """

    def __init__(
        self, calls: DataFrame, spread_on: list[str] = SPREAD_ON, floor: int = HEAVY_FLOOR, fan: int = FAN_OUT,
        counted: DataFrame | None = None, many: int = MANY_CALLS,
    ):
        self.frame = with_locus(calls)
        self._heavy, n = counted_heavy_hashes(self.frame if counted is None else with_locus(counted), LOCUS, floor)
        if self._heavy:
            spread = spread_number(LOCUS, self._heavy, spread_on, fan)
            apart = F.when(F.col(SPREAD) > 0, F.concat(F.lit("~"), F.col(SPREAD))).otherwise(F.col("locus_alt"))
            self.frame = self.frame.withColumn(SPREAD, spread).withColumn(JOIN_ALT, apart)
        if n >= many:
            tasks = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // CALLS_A_TASK))
            self.frame = self.frame.repartition(tasks, *LOCUS[:3], JOIN_ALT if self._heavy else LOCUS[3])

    def left(self, store: DataFrame, columns: dict[str, Column]) -> "LocusJoins":
        """Add ``columns`` of a store holding one row per locus."""
        keyed = store.select(*LOCUS, *[c.alias(n) for n, c in columns.items()])
        if not self._heavy:
            self.frame = self.frame.join(keyed.hint("merge"), LOCUS, "left")
            return self
        before = self.frame.columns
        apart = keyed.withColumnRenamed("locus_alt", JOIN_ALT)
        joined = self.frame.join(apart.hint("merge"), [*LOCUS[:3], JOIN_ALT], "left")
        joined = joined.join(heavy_rows(keyed, LOCUS, self._heavy), LOCUS, "left")
        value = lambda n: F.when(F.col(SPREAD) > 0, F.col(f"_hot.{n}")).otherwise(F.col(n)).alias(n)
        self.frame = joined.select(*before, *[value(n) for n in columns])
        return self

    def done(self) -> DataFrame:
        return self.frame.drop(*OWN_COLUMNS)


def _column(store: DataFrame, name: str, type_: str) -> Column:
    """Column of a store, or a typed NULL where that store lacks it."""
    return F.col(name).cast(type_) if name in store.columns else F.lit(None).cast(type_)


def join_frequency(joins: LocusJoins, store: DataFrame) -> LocusJoins:
    return joins.left(
        with_locus(store),
        {
            "store_matched": F.lit(True),
            "store_filter": _column(store, "filter", "string"),
            "store_af": F.coalesce(_column(store, "af_grpmax", "double"), _column(store, "af", "double")),
            "store_ac": _column(store, "ac", "bigint"),
            "store_an": _column(store, "an", "bigint"),
            "store_hom": _column(store, "nhomalt", "bigint"),
            "store_faf95": _column(store, "faf95", "double"),
            "store_pop": _column(store, "grpmax_pop", "string"),
        },
    )


STORE_COLUMNS = [
    "store_matched", "store_filter", "store_af", "store_ac", "store_an", "store_hom",
    "store_faf95", "store_pop",
]


def frequency_state(coverage: Coverage, inside: Column | None = None) -> Column:
    """``frequency``, ``filtered``, ``absent`` or ``unknown`` for each call."""
    passed = F.coalesce(F.upper("store_filter") == "PASS", F.lit(True))
    covered = F.col("locus_chrom").isin(*coverage.contigs) if coverage.contigs else F.lit(False)
    mode = coverage.effective_mode
    vouched = {"full": covered, "bed": covered & inside if inside is not None else F.lit(False)}.get(
        mode, F.lit(False)
    )
    return (
        F.when(F.col("store_matched") & passed, "frequency")
        .when(F.col("store_matched"), "filtered")
        .when(vouched, "absent")
        .otherwise("unknown")
    )


def flag_covered(calls: DataFrame, coverage: Coverage) -> DataFrame:
    """Calls with ``_in_panel`` where the coverage needs it, from position bit maps, before any store is joined."""
    if coverage.effective_mode != "bed":
        return calls
    return flag_inside(calls, coverage.regions, SPREAD_ON, "_in_panel")


def resolve_frequency(joined: DataFrame, coverage: Coverage) -> DataFrame:
    """Replace raw store columns by the resolved frequency; unknown stays NULL.

    A BED store's coverage is read from ``_in_panel`` (``flag_covered``).
    """
    inside = F.col("_in_panel") if coverage.effective_mode == "bed" else None
    state = F.col("frequency_state")
    value = lambda stored, absent: F.when(state == "frequency", F.col(stored)).when(state == "absent", absent)
    resolved = {
        "gnomad_af": value("store_af", F.lit(0.0)),
        "gnomad_ac": value("store_ac", F.lit(0)),
        "gnomad_an": value("store_an", F.lit(0)),
        "gnomad_homozygotes": value("store_hom", F.lit(0)),
        "gnomad_faf95": value("store_faf95", F.lit(0.0)),
        "gnomad_popmax_pop": F.when(state == "frequency", F.col("store_pop")),
    }
    return (
        joined.withColumn("frequency_state", frequency_state(coverage, inside))
        .withColumns(resolved)
        .drop(*STORE_COLUMNS, "_in_panel")
    )


def with_frequency(calls: DataFrame, store: DataFrame, coverage: Coverage, **skew) -> DataFrame:
    """Calls with the population frequency of their locus."""
    joins = LocusJoins(flag_covered(calls, coverage), counted=calls, **skew)
    return resolve_frequency(join_frequency(joins, store).frame, coverage).drop(*OWN_COLUMNS)


def join_assertions(joins: LocusJoins, store: DataFrame) -> LocusJoins:
    """Clinical assertions; rows without a significance count as no record."""
    text = lambda name: F.when(F.col(name) != "", F.col(name))
    usable = with_locus(store.where(F.col("significance") != ""))
    return joins.left(
        usable,
        {
            "clinvar_significance": F.col("significance"),
            "clinvar_review_status": text("review_status"),
            "clinvar_accession": text("accession"),
            "clinvar_condition": text("condition"),
        },
    )


def join_missense(joins: LocusJoins, store: DataFrame) -> LocusJoins:
    return joins.left(
        with_locus(store),
        {"am_pathogenicity": F.col("am_pathogenicity"), "am_class": F.col("am_class")},
    )


def join_local_frequency(joins: LocusJoins, table: DataFrame) -> LocusJoins:
    return joins.left(locus_from_key(table), {"abraom_af": F.col("af")})


def join_predictors(joins: LocusJoins, table: DataFrame) -> LocusJoins:
    return joins.left(locus_from_key(table), {"revel": F.col("revel"), "cadd_phred": F.col("cadd")})


def curated_modes(gene: Column) -> Column:
    return F.element_at(literal_map(CURATED_INHERITANCE), F.upper(gene))


def gene_profile(
    genes: DataFrame,
    constraint: DataFrame,
    haploinsufficient: DataFrame,
    phenotype_modes: DataFrame,
    secondary: DataFrame,
) -> DataFrame:
    """One row per gene spelling seen in the calls, from four gene tables.

    Haploinsufficiency and inheritance ignore letter case, constraint and the
    secondary-findings list do not. A gene without a constraint row stays NULL.
    """
    spelled = genes.select("gene").where(F.col("gene").isNotNull()).distinct().withColumn("_upper", F.upper("gene"))
    flag = lambda name: F.lit(True).alias(name)
    upper = lambda df: df.withColumn("_upper", F.upper("gene")).drop("gene")
    curated = curated_modes(F.col("gene"))
    none = F.array().cast("array<string>")
    return (
        spelled.join(constraint.select("gene", "lof_intolerant"), "gene", "left")
        .join(upper(haploinsufficient.select("gene")).select("_upper", flag("_hi")).distinct(), "_upper", "left")
        .join(upper(phenotype_modes).select("_upper", F.col("modes").alias("_modes")), "_upper", "left")
        .join(secondary.select("gene", flag("_sf")).distinct(), "gene", "left")
        .select(
            "gene",
            "lof_intolerant",
            F.coalesce("_hi", F.lit(False)).alias("haploinsufficient"),
            F.coalesce(F.when(curated.isNotNull(), F.array(curated)), F.col("_modes"), none).alias("modes"),
            F.coalesce(F.array_contains("_modes", "AR"), F.lit(False)).alias("recessive_mechanism"),
            F.coalesce("_sf", F.lit(False)).alias("secondary_gene"),
        )
    )


def with_gene_profile(calls: DataFrame, profile: DataFrame) -> DataFrame:
    """Gene-level columns; a call without a gene gets the neutral values.

    The profile has one row per gene and goes to the calls if it is small as measured, so the
    calls, which are wide and share few genes, are not moved.
    """
    no = F.lit(False)
    joined = attach(calls, profile, ["gene"], [x for x in SPREAD_ON if x in calls.columns] or ["gene"])
    return joined.withColumns(
        {
            "haploinsufficient": F.coalesce("haploinsufficient", no),
            "modes": F.coalesce("modes", F.array().cast("array<string>")),
            "recessive_mechanism": F.coalesce("recessive_mechanism", no),
            "secondary_gene": F.coalesce("secondary_gene", no),
        }
    )


def prefer_carried(annotated: DataFrame) -> DataFrame:
    """Evidence in INFO wins over joined evidence whenever the field is present.

    Presence alone decides: an unusable carried value gives NULL, not the store's value.
    Needs ``info, alt_index`` beside the joined columns; ``evidence_source`` names the winner.
    """
    taken = annotated.withColumn("_own", carried_annotation(F.col("info"), F.col("alt_index")))
    groups = {
        "has_gnomad": ["gnomad_af", "gnomad_ac", "gnomad_an", "gnomad_homozygotes", "gnomad_faf95"],
        "has_abraom": ["abraom_af"],
        "has_clinvar": ["clinvar_significance", "clinvar_review_status", "clinvar_condition", "clinvar_accession"],
        "has_insilico": ["revel", "cadd_phred"],
        "has_missense": ["am_pathogenicity", "am_class"],
    }
    chosen, sources = {}, []
    for flag, columns in groups.items():
        own = F.col(f"_own.{flag}")
        for c in columns:
            stored = F.col(c) if c in annotated.columns else F.lit(None)
            chosen[c] = F.when(own, F.col(f"_own.{c}")).otherwise(stored)
        name = flag.removeprefix("has_")
        head = columns[0]
        stored_here = F.col(head).isNotNull() if head in annotated.columns else F.lit(False)
        sources += [F.lit(name), F.when(own, "info").when(stored_here, "store").otherwise("none")]
    if "gnomad_popmax_pop" in annotated.columns:
        chosen["gnomad_popmax_pop"] = F.when(~F.col("_own.has_gnomad"), F.col("gnomad_popmax_pop"))
    return taken.withColumns({**chosen, "evidence_source": F.create_map(*sources)}).drop("_own")


COORDINATE_EVIDENCE = [
    "gnomad_af", "gnomad_ac", "gnomad_an", "gnomad_homozygotes", "gnomad_faf95", "gnomad_popmax_pop",
    "clinvar_significance", "clinvar_review_status", "clinvar_accession", "clinvar_condition",
    "abraom_af", "revel", "cadd_phred", "am_pathogenicity", "am_class",
]


def trust_build(annotated: DataFrame, build: str = "build") -> DataFrame:
    """Drop coordinate evidence where the file declares another genome build.

    An undeclared build is trusted; ``build_warning`` marks both cases, and evidence that
    is dropped has no source.
    """
    trusted = F.col(build).isNull() | (F.col(build) == GENOME_BUILD)
    warning = F.when(F.col(build).isNull(), "undeclared").when(~trusted, "mismatch")
    blanked = {c: F.when(trusted, F.col(c)) for c in COORDINATE_EVIDENCE if c in annotated.columns}
    if "evidence_source" in annotated.columns:
        nowhere = F.transform_values("evidence_source", lambda _, source: F.lit("none"))
        blanked["evidence_source"] = F.when(trusted, F.col("evidence_source")).otherwise(nowhere)
    return annotated.withColumns({**blanked, "build_warning": warning})
