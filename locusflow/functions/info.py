"""Reading INFO text and the annotation fields a call already carries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusflow.functions.binding import let
from locusflow.settings import INFO_ALIASES


def info_map(info: Column) -> Column:
    """INFO text as a map: flags become ``true``, the last of repeated keys wins."""
    pairs = F.transform(
        F.split(info, ";"),
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("key"),
            F.when(F.contains(item, F.lit("=")), F.substr(item, F.instr(item, "=") + 1))
            .otherwise("true")
            .alias("value"),
        ),
    )

    def last_of_each(found: Column, keys: Column) -> Column:
        repeated = lambda p, i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"])
        once = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(once, found).otherwise(F.filter(found, lambda p, i: ~repeated(p, i)))

    kept = let(pairs, lambda found: let(F.transform(found, lambda p: p["key"]), lambda keys: last_of_each(found, keys)))
    empty = F.create_map().cast("map<string,string>")
    return F.when(info.isNull() | info.isin(".", ""), empty).otherwise(F.map_from_entries(kept))


def stated_info(info: Column, keys: Sequence[str]) -> Column:
    """INFO text between semicolons, with ``true`` as the value of those of ``keys`` that stand as flags; for ``info_value``."""
    whole = F.concat(F.lit(";"), info, F.lit(";"))
    stated = whole
    for key in keys:
        stated = F.replace(stated, F.lit(f";{key};"), F.lit(f";{key}=true;"))
    return F.when(whole.rlike(f";({'|'.join(map(re.escape, keys))});"), stated).otherwise(whole)


def info_value(stated: str, key: str) -> Column:
    """The value that ``info_map`` has under ``key``, or an empty text, without building the map.

    The last of repeated keys wins. If there is none, what is left is the empty text before the first semicolon.
    """
    return F.substring_index(F.substring_index(stated, f";{key}=", -1), ";", 1)


def first_usable(info: Column, names: list[str]) -> Column:
    """Value of the first key that is present and neither empty nor ``.``."""
    usable = lambda value: F.when(~value.isin("", "."), value)
    return F.coalesce(*[usable(F.element_at(info, name)) for name in names])


def alias_value(info: Column, field: str) -> Column:
    return first_usable(info, INFO_ALIASES[field])


def per_allele(text: Column, index: Column) -> Column:
    """Element for this allele; a single value serves every allele, a short list serves none."""
    return let(F.split(text, ","), lambda parts: allele_element(parts, index))


def allele_element(parts: Column, index: Column) -> Column:
    """``per_allele`` of a text that is split already."""
    return F.when(index < F.size(parts), F.get(parts, index)).when(F.size(parts) == 1, F.get(parts, F.lit(0)))


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def allele_number_value(text: Column, index: Column) -> Column:
    return number(per_allele(text, index))


def allele_count_value(text: Column, index: Column) -> Column:
    return allele_number_value(text, index).try_cast("bigint")


def largest_number(text: Column) -> Column:
    """Largest numeric token of a per-transcript list separated by ``;``, ``,`` or ``&``."""
    tokens = F.transform(F.split(text, "[;,&]"), number)
    return F.array_max(F.filter(tokens, lambda x: x.isNotNull()))


def carried_annotation(info: Column, index: Column) -> Column:
    """Evidence already present in INFO, with a presence flag for each source.

    Presence decides precedence even when the value itself is unusable, so the
    flags are kept apart from the values.
    """
    spaced = lambda c: F.translate(c, "_", " ")
    af = alias_value(info, "gnomad_af")
    abraom = alias_value(info, "abraom_af")
    significance = alias_value(info, "clinvar_sig")
    revel = largest_number(alias_value(info, "revel"))
    cadd = largest_number(alias_value(info, "cadd"))
    missense = largest_number(alias_value(info, "am_pathogenicity"))
    only = lambda present, value: F.when(present, value)
    has_af, has_sig, has_am = af.isNotNull(), significance.isNotNull(), missense.isNotNull()
    return F.struct(
        has_af.alias("has_gnomad"),
        only(has_af, allele_number_value(af, index)).alias("gnomad_af"),
        only(has_af, allele_count_value(alias_value(info, "gnomad_ac"), index)).alias("gnomad_ac"),
        only(has_af, allele_count_value(alias_value(info, "gnomad_an"), index)).alias("gnomad_an"),
        only(has_af, allele_count_value(alias_value(info, "gnomad_hom"), index)).alias("gnomad_homozygotes"),
        only(has_af, allele_number_value(alias_value(info, "gnomad_faf95"), index)).alias("gnomad_faf95"),
        abraom.isNotNull().alias("has_abraom"),
        allele_number_value(abraom, index).alias("abraom_af"),
        has_sig.alias("has_clinvar"),
        spaced(significance).alias("clinvar_significance"),
        only(has_sig, spaced(alias_value(info, "clinvar_review"))).alias("clinvar_review_status"),
        only(has_sig, spaced(alias_value(info, "clinvar_disease"))).alias("clinvar_condition"),
        only(has_sig, alias_value(info, "clinvar_accession")).alias("clinvar_accession"),
        (revel.isNotNull() | cadd.isNotNull()).alias("has_insilico"),
        revel.alias("revel"),
        cadd.alias("cadd_phred"),
        has_am.alias("has_missense"),
        missense.alias("am_pathogenicity"),
        only(has_am, alias_value(info, "am_class")).alias("am_class"),
    )
