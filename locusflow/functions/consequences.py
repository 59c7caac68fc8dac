"""Consequence and HGVS text from annotator fields in INFO."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusflow.functions.binding import let
from locusflow.functions.keys import allele_matches, minimal_allele
from locusflow.settings import (
    AMINO_ACIDS,
    CONSEQUENCE_SEVERITY,
    LEGACY_EFFECTS,
    LEGACY_IMPACT,
    RECORD_CONSEQUENCES,
)

FIELDS = ["gene", "consequence", "hgvs_c", "hgvs_p", "exon", "transcript"]


def _text(c: Column) -> Column:
    return F.when(c != "", c)


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def first_term(terms: Column) -> Column:
    return _text(F.trim(F.substring_index(terms, "&", 1)))


def _effect(**values: Column) -> Column:
    return F.struct(*[values.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


def _usable(effect: Column) -> Column:
    return let(effect, lambda e: F.when(e["gene"].isNotNull() | e["consequence"].isNotNull(), e))


def _entries(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda e: F.split(e, "[|]"))


def pick_ann(ann: Column, ref: Column, alt: Column, n_alts: Column) -> Column:
    """ANN: first entry naming this allele, else the first entry of a single-ALT record."""

    def effect(entry: Column) -> Column:
        fields = _effect(
            gene=_text(entry[3]),
            consequence=first_term(entry[1]),
            hgvs_c=_text(entry[9]),
            hgvs_p=_text(entry[10]),
            exon=_text(entry[8]),
            transcript=_text(entry[6]),
        )
        return F.when(entry.isNotNull(), fields)

    def choose(complete: Column, minimal: Column) -> Column:
        named = F.filter(complete, lambda f: allele_matches(f[0], ref, alt, minimal))
        return let(
            F.coalesce(F.get(named, F.lit(0)), F.when(n_alts == 1, F.get(complete, F.lit(0)))), effect
        )

    complete = F.filter(_entries(ann), lambda f: F.size(f) >= 11)
    return let(minimal_allele(ref, alt), lambda m: let(complete, lambda found: choose(found, m)))


def percent_decoded(text: Column) -> Column:
    """Decode percent escapes; a plus sign and malformed escapes stay as they are."""
    decoded = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def pick_csq(
    csq: Column, fields: Column, ref: Column, alt: Column, alt_index: Column, n_alts: Column
) -> Column:
    """CSQ: this allele's entries, then PICK, CANONICAL, MANE_SELECT, first in that order."""
    lower = F.transform(fields, lambda name: F.lower(name))
    return let(
        lower,
        lambda names: let(
            minimal_allele(ref, alt),
            lambda minimal: _csq_effect(csq, names, ref, alt, minimal, alt_index, n_alts),
        ),
    )


def _csq_effect(csq, names, ref, alt, minimal, alt_index, n_alts) -> Column:
    def raw(entry: Column, name: str) -> Column:
        return let(
            F.array_position(names, F.lit(name)).cast("int"),
            lambda at: F.when(at > 0, _text(F.get(entry, at - 1))),
        )

    def value(entry: Column, name: str) -> Column:
        return let(raw(entry, name), percent_decoded)

    def names_allele(entry: Column) -> Column:
        by_text = let(raw(entry, "allele"), lambda named: allele_matches(named, ref, alt, minimal))
        by_number = raw(entry, "allele_num") == (alt_index + 1).cast("string")
        return F.coalesce(by_number, by_text, F.lit(False))

    def effect(entry: Column) -> Column:
        fields = _effect(
            gene=F.coalesce(value(entry, "symbol"), value(entry, "gene")),
            consequence=first_term(value(entry, "consequence")),
            hgvs_c=value(entry, "hgvsc"),
            hgvs_p=value(entry, "hgvsp"),
            exon=value(entry, "exon"),
            transcript=value(entry, "feature"),
        )
        return F.when(entry.isNotNull(), fields)

    def best(pool: Column) -> Column:
        first_where = lambda test: F.get(F.filter(pool, test), F.lit(0))
        return F.coalesce(
            first_where(lambda e: raw(e, "pick") == "1"),
            first_where(lambda e: raw(e, "canonical") == "YES"),
            first_where(lambda e: raw(e, "mane_select").isNotNull()),
            F.get(pool, F.lit(0)),
        )

    def pool_of(entries: Column) -> Column:
        named = F.filter(entries, names_allele)
        return let(named, lambda own: F.when(F.size(own) > 0, own).when(n_alts == 1, entries))

    return let(_entries(csq), lambda entries: let(pool_of(entries), lambda pool: let(best(pool), effect)))


def legacy_protein_change(change: Column) -> Column:
    """``W169R`` to ``p.Trp169Arg``."""
    pattern = r"^([A-Z*])(\d+)([A-Z*])$"
    names = literal_map(AMINO_ACIDS)
    part = lambda i: F.regexp_extract(change, pattern, i)
    residue = lambda i: F.coalesce(F.element_at(names, part(i)), part(i))
    return F.when(
        change.rlike(pattern), F.concat(F.lit("p."), residue(1), part(2), residue(3))
    )


def pick_eff(eff: Column, alt_index: Column, n_alts: Column) -> Column:
    """Legacy EFF: highest impact for this ALT, protein-coding preferred, first on ties."""
    impact, effects = literal_map(LEGACY_IMPACT), literal_map(LEGACY_EFFECTS)

    def scored(e: Column, i: Column) -> Column:
        inside = F.split(F.regexp_replace(F.substr(e, F.instr(e, "(") + 1), r"\)+$", ""), "[|]")
        return let(
            inside,
            lambda f: F.struct(
                (
                    F.coalesce(F.element_at(impact, F.get(f, F.lit(0))), F.lit(0)) * 2
                    + F.when(F.get(f, F.lit(6)) == "protein_coding", 1).otherwise(0)
                ).alias("score"),
                (-i).alias("order"),
                F.trim(F.substring_index(e, "(", 1)).alias("effect"),
                f.alias("f"),
                F.contains(e, F.lit("(")).alias("shaped"),
            ),
        )

    def eligible(entry: Column) -> Column:
        genotype = F.get(entry["f"], F.lit(10))
        other_allele = (n_alts > 1) & genotype.rlike(r"^\d+$") & (genotype.try_cast("int") != alt_index + 1)
        return entry["shaped"] & (F.size(entry["f"]) >= 10) & ~F.coalesce(other_allele, F.lit(False))

    def effect(best: Column) -> Column:
        fields = _effect(
            gene=_text(best["f"][5]),
            consequence=F.coalesce(F.element_at(effects, best["effect"]), _text(F.lower(best["effect"]))),
            hgvs_p=legacy_protein_change(best["f"][3]),
            exon=_text(best["f"][9]),
            transcript=_text(best["f"][8]),
        )
        return F.when(best.isNotNull(), fields)

    entries = F.transform(F.split(eff, ","), scored)
    return let(F.array_max(F.filter(entries, eligible)), effect)


def effect_of(
    info: Column, csq_fields: Column, ref: Column, alt: Column, alt_index: Column, n_alts: Column
) -> Column:
    """Best effect: ANN, then EFF, then structured CSQ, then plain INFO keys."""
    at = lambda name: _text(F.element_at(info, name))
    csq = at("CSQ")
    piped = F.contains(csq, F.lit("|"))
    plain = _effect(
        gene=F.element_at(info, "GENE"),
        consequence=F.when(~piped, csq),
        hgvs_c=F.element_at(info, "HGVSC"),
        hgvs_p=F.element_at(info, "HGVSP"),
        transcript=F.coalesce(at("TRANSCRIPT"), F.element_at(info, "FEATURE")),
    )
    return F.coalesce(
        F.when(at("ANN").isNotNull(), _usable(pick_ann(at("ANN"), ref, alt, n_alts))),
        F.when(at("EFF").isNotNull(), _usable(pick_eff(at("EFF"), alt_index, n_alts))),
        F.when(
            piped & csq_fields.isNotNull(),
            _usable(pick_csq(csq, csq_fields, ref, alt, alt_index, n_alts)),
        ),
        plain,
    )


def consequence_from_protein(change: Column, ref: Column, alt: Column) -> Column:
    """Consequence class read from protein-change text and allele lengths."""
    text = F.coalesce(change, F.lit(""))
    length_change = F.length(ref) - F.length(alt)
    in_frame = (F.abs(length_change) % 3 == 0) & (length_change != 0)
    return (
        F.when(text.contains("fs") | F.lower(text).contains("frameshift"), "frameshift_variant")
        .when(text.rlike(r"(Ter|\*)\)?$"), "stop_gained")
        .when(text.contains("Met1") | text.contains("M1"), "start_lost")
        .when(text.rlike("del|dup|ins"), F.when(in_frame, "inframe_indel").otherwise("frameshift_variant"))
        .when(text.rlike(r"p\.[A-Z][a-z][a-z]\d+[A-Z][a-z][a-z]"), "missense_variant")
        .when((F.length(ref) == 1) & (F.length(alt) == 1), "missense_variant")
        .otherwise("other")
    )


def most_severe_record_consequence(terms: Column, title: Column) -> Column:
    """Most severe known term of an assertion record, else what its title implies."""
    known = literal_map(RECORD_CONSEQUENCES)
    mapped = F.transform(terms, lambda t: F.element_at(known, F.lower(F.trim(t))))
    severity = F.array(*[F.lit(c) for c in CONSEQUENCE_SEVERITY])
    from_terms = F.get(
        F.filter(severity, lambda s: F.coalesce(F.array_contains(F.array_compact(mapped), s), F.lit(False))),
        F.lit(0),
    )
    low = F.lower(F.coalesce(title, F.lit("")))
    from_title = (
        F.when(low.contains("ter)") | low.contains("*)") | low.contains("=stop"), "stop_gained")
        .when(low.contains("fs") & low.contains("p."), "frameshift_variant")
        .when(low.contains("p.(=)") | low.contains("p.="), "synonymous_variant")
        .otherwise("")
    )
    return F.coalesce(from_terms, from_title)


def protein_change_from_title(title: Column) -> Column:
    held = title.contains("(p.") & title.endswith(")")
    tail = F.substring_index(title, "(p.", -1)
    return F.when(held, F.concat(F.lit("p."), F.substr(tail, F.lit(1), F.length(tail) - 1))).otherwise("")
