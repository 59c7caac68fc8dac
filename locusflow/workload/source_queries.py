"""Queries that write text from the derived relations, read it back and compare with the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import consequences as cq
from locusflow.functions import info as nf
from locusflow.functions import keys as K
from locusflow.operators import health as hl
from locusflow.operators import selection as sel
from locusflow.operators import sinks as sk
from locusflow.operators.durable import shared_path
from locusflow.operators.ranking import first_per_key
from locusflow.sources import intervals as si
from locusflow.sources import joint as jt
from locusflow.sources import ontology as on
from locusflow.sources import phenopacket as pk
from locusflow.sources import records as rec
from locusflow.sources import stores as so
from locusflow.sources import tables as tb
from locusflow.sources import vcf
from locusflow.sources.block_gzip import RANGE_BYTES, read_block_gzip, write_block_gzip
from locusflow.workload.inputs import inputs
from locusflow.workload.registry import query

c = F.col
TAB = "\t"


def rows(name: str):
    return F.count(F.lit(1)).alias(name)


def tabbed(*fields: Column | str) -> Column:
    return F.concat_ws(TAB, *[F.coalesce(c(f) if isinstance(f, str) else f, F.lit(".")) for f in fields])


def as_lines(df: DataFrame, value: Column, file: Column | None = None, line_no: Column | None = None) -> DataFrame:
    return df.select(
        (file if file is not None else F.lit("f")).alias("file"),
        (line_no if line_no is not None else F.monotonically_increasing_id()).alias("line_no"),
        value.alias("value"),
    )


COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def call_lines(calls: DataFrame) -> DataFrame:
    """One VCF per sample: header, records and a few malformed lines."""
    allele = (c("alt_index") + 1).cast("string")
    genotype = (
        F.when(c("zygosity") == "het", F.concat(F.lit("0/"), allele))
        .when(c("zygosity") == "hom", F.concat(allele, F.lit("|"), allele))
        .when(c("zygosity") == "hemi", allele).otherwise("./.")
    )
    share = F.round(c("allele_balance") * 100).cast("int").cast("string")
    rest = (F.lit(100) - F.round(c("allele_balance") * 100).cast("int")).cast("string")
    second = c("n_alts") == 2
    depths = F.when(~second, F.concat_ws(",", rest, share)).when(c("alt_index") == 0, F.concat_ws(",", rest, share, F.lit("0"))).otherwise(
        F.concat_ws(",", rest, F.lit("0"), share)
    )
    depth = F.when(c("line_no") % 5 == 0, ".").otherwise(c("depth").cast("string"))
    sample = F.concat_ws(":", genotype, depth, F.concat(c("gq").cast("string"), F.lit(".0")), depths)
    alts = F.when(~second, c("alt")).when(c("alt_index") == 0, F.concat(c("alt"), F.lit(",*"))).otherwise(F.concat(F.lit("<DEL>,"), c("alt")))
    info = F.concat(
        F.lit("GENE=old;DB;GENE="), c("gene"), F.lit(";CSQ="), c("consequence"), F.lit(";HGVSC="), c("hgvs_c"),
        F.lit(";HGVSP="), c("hgvs_p"), F.lit(";TRANSCRIPT="), c("transcript"),
    )
    record = tabbed("chrom", c("pos").cast("string"), "variant_id", "ref", alts, F.lit("50"), "filter_status", info, F.lit("GT:DP:GQ:AD"), sample)
    records = as_lines(calls, record, c("sample_id"), c("line_no"))
    broken = F.array(F.lit("chr1\t5\t."), F.lit("chr1\tx\t.\tA\tC\t.\tPASS\tDB"), F.lit("chr1\t9\t.\tA\t\t.\tPASS\tDB"))
    samples = calls.select("sample_id").distinct()
    even = F.substr("sample_id", F.lit(2)).cast("bigint") % 2 == 0
    header = samples.select(
        c("sample_id").alias("file"),
        F.posexplode(
            F.concat(
                F.array(
                    F.lit("##fileformat=VCFv4.2"),
                    F.when(even, "##reference=file:///ref/GRCh38.fa").otherwise("##contig=<ID=1,assembly=b37>"),
                    F.lit('##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence Format: Allele|Consequence|SYMBOL">'),
                    F.concat(F.lit(COLUMNS), c("sample_id")),
                ),
                broken,
            )
        ).alias("line_no", "value"),
    ).withColumn("line_no", (c("line_no") - 100).cast("bigint"))
    return header.unionByName(records)


def stored_call_lines(i) -> DataFrame:
    """The text as a stored table, so that parsing starts from text and not from its derivation."""
    return i.keep("call_lines", lambda: call_lines(i.calls))


@query(
    "SRC1_to_SRC6_vcf_calls",
    """SELECT sample_id, line_no, chrom, pos, ref, alt, gene, consequence, hgvs_c, hgvs_p, transcript, zygosity,
       CASE WHEN line_no % 5 = 0 THEN 100 ELSE depth END AS depth, gq, allele_balance, filter_status, variant_id, n_alts, alt_index FROM calls""",
)
def _(spark, d):
    parsed = vcf.parse_calls(stored_call_lines(inputs(spark, d)))
    return parsed.select(
        "sample_id", "line_no", "chrom", "pos", "ref", "alt", "gene", "consequence", "hgvs_c", "hgvs_p", "transcript",
        "zygosity", "depth", "gq", "allele_balance", "filter_status", "variant_id", "n_alts", "alt_index",
    )


@query(
    "SRC2_block_gzip_calls",
    """SELECT sample_id, line_no, chrom, pos, ref, alt, gene, consequence, zygosity, gq, allele_balance, filter_status, true AS many_tasks FROM calls""",
)
def _(spark, d):
    i = inputs(spark, d)

    def build() -> str:
        path = shared_path(spark, "gzip")
        whole = stored_call_lines(i).select(F.concat_ws(TAB, "file", c("line_no").cast("string"), "value").alias("value"))
        write_block_gzip(whole, path)
        return path

    path = i.once("block gzip", build)
    held = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    # Small files are cut finely, so that there are many tasks; large ones into the usual ranges.
    text = read_block_gzip(spark, path, range_bytes=min(RANGE_BYTES, max(64 << 10, held // 64)))
    fields = F.split("value", TAB, 3)
    lines = i.keep(
        "block gzip lines",
        lambda: text.select(
            fields[0].alias("file"), fields[1].cast("bigint").alias("line_no"), fields[2].alias("value"), F.spark_partition_id().alias("p")
        ),
    )
    many = lines.agg((F.countDistinct("p") > 2).alias("many_tasks"))
    parsed = vcf.parse_calls(lines).withColumn("many_tasks", many.scalar())
    return parsed.select(
        "sample_id", "line_no", "chrom", "pos", "ref", "alt", "gene", "consequence", "zygosity", "gq", "allele_balance", "filter_status", "many_tasks"
    )


@query(
    "SRC3_SRC4_FN6_file_headers",
    """SELECT DISTINCT sample_id AS file, CASE WHEN CAST(substr(sample_id, 2) AS BIGINT) % 2 = 0 THEN 'GRCh38' ELSE 'GRCh37' END AS build,
       sample_id AS samples, 'Allele|Consequence|SYMBOL' AS csq FROM calls""",
)
def _(spark, d):
    headers = vcf.file_headers(stored_call_lines(inputs(spark, d)))
    return headers.select("file", "build", F.array_join("sample_names", ",").alias("samples"), F.array_join("csq_fields", "|").alias("csq"))


@query("FLT6_sample_choice", "SELECT DISTINCT sample_id AS file, 1 AS n_samples, false AS defaulted_to_first FROM calls")
def _(spark, d):
    return sel.sample_choice_warning(vcf.file_headers(stored_call_lines(inputs(spark, d))), None)


@query(
    "FN4_depth_and_balance",
    """SELECT sample_id, line_no, CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN depth + 10 ELSE depth END AS depth,
       CASE k WHEN 3 THEN round(10.0 / (10 + depth), 3) WHEN 2 THEN round(10.0 / (10 + depth), 3) END AS balance
       FROM (SELECT *, CAST((line_no // 8000000) % 4 AS INT) AS k FROM calls) x""",
)
def _(spark, d):
    kind = F.floor(c("line_no") / 8000000) % 4
    depth = c("depth").cast("string")
    ad = F.when(kind == 0, F.concat(depth, F.lit(",."))).when(kind == 1, depth).otherwise(F.concat(depth, F.lit(",10")))
    dp = F.when(kind == 3, depth).otherwise(".")
    metrics = vcf.sample_metrics(F.lit("GT:DP:AD"), F.concat_ws(":", F.lit("0/1"), dp, ad), F.lit(0))
    return inputs(spark, d).calls.withColumn("m", metrics).select(
        "sample_id", "line_no", c("m.depth").alias("depth"), c("m.allele_balance").alias("balance")
    )


@query(
    "FN5_reportable_alleles",
    "SELECT alt, k, k = 3 AS reportable, count(*) AS n FROM (SELECT alt, (line_no // 8000000) % 4 AS k FROM calls) x GROUP BY ALL",
)
def _(spark, d):
    kind = F.floor(c("line_no") / 8000000) % 4
    shown = F.when(kind == 0, "*").when(kind == 1, "<NON_REF>").when(kind == 2, ".").otherwise(c("alt"))
    return inputs(spark, d).calls.select("alt", kind.alias("k"), K.reportable_allele(shown).alias("reportable")).groupBy("alt", "k", "reportable").agg(rows("n"))




def _kind() -> Column:
    return F.floor(c("line_no") / 8000000) % 3


_PICKED = """SELECT sample_id, line_no, CASE k WHEN 0 THEN gene WHEN 1 THEN 'OTHER' WHEN 2 THEN CASE WHEN n_alts = 1 THEN 'OTHER' END END AS gene,
  CASE k WHEN 0 THEN consequence WHEN 1 THEN 'intron_variant' WHEN 2 THEN CASE WHEN n_alts = 1 THEN 'intron_variant' END END AS consequence,
  CASE k WHEN 0 THEN hgvs_p END AS hgvs_p
FROM (SELECT *, (line_no // 8000000) % 3 AS k FROM calls) x"""


def _effect_columns(df: DataFrame, effect: Column) -> DataFrame:
    return df.withColumn("e", effect).select(
        "sample_id", "line_no", c("e.gene").alias("gene"), c("e.consequence").alias("consequence"), c("e.hgvs_p").alias("hgvs_p")
    )


@query("FN7_FN8_FN9_ann_pick", _PICKED)
def _(spark, d):
    def entry(allele, gene, consequence, protein):
        return F.concat_ws("|", allele, consequence, F.lit("HIGH"), gene, F.lit("id"), F.lit("transcript"), F.lit("T1"), F.lit("protein_coding"), F.lit("1/2"), F.lit("c.1"), protein)

    other = entry(F.when(_kind() == 1, c("alt")).otherwise(F.lit("TTTTT")), F.lit("OTHER"), F.lit("intron_variant&x"), F.lit(""))
    mine = entry(F.when(_kind() == 2, F.lit("GGGGG")).otherwise(K.minimal_allele(c("ref"), c("alt"))), c("gene"), F.concat(c("consequence"), F.lit("&splice_region_variant")), c("hgvs_p"))
    text = F.concat_ws(",", F.lit("short|entry"), other, mine)
    return _effect_columns(inputs(spark, d).calls, cq.pick_ann(text, c("ref"), c("alt"), c("n_alts")))


@query(
    "FN10_csq_pick",
    """SELECT sample_id, line_no, CASE k WHEN 0 THEN gene WHEN 1 THEN 'PICKED' ELSE 'CANON' END AS gene,
       CASE k WHEN 0 THEN consequence ELSE 'intron_variant' END AS consequence, CASE k WHEN 0 THEN 'p.=+x' END AS hgvs_p
       FROM (SELECT *, (line_no // 8000000) % 3 AS k FROM calls) x""",
)
def _(spark, d):
    fields = F.array(*[F.lit(x) for x in ("Allele", "Consequence", "SYMBOL", "Gene", "HGVSp", "ALLELE_NUM", "PICK", "CANONICAL", "MANE_SELECT")])
    own = (c("alt_index") + 1).cast("string")
    blank = F.lit("")

    def entry(number, gene, consequence, protein, pick, canonical, mane):
        return F.concat_ws("|", F.lit("X"), consequence, gene, F.lit("ENSG"), protein, number, pick, canonical, mane)

    wrong = entry((c("alt_index") + 2).cast("string"), F.lit("WRONG"), F.lit("stop_lost"), blank, F.lit("1"), F.lit("YES"), blank)
    mane = entry(own, F.when(_kind() == 0, c("gene")).otherwise("MANE"), F.when(_kind() == 0, c("consequence")).otherwise("intron_variant"),
                 F.when(_kind() == 0, "p.%3D+x").otherwise(""), blank, blank, F.lit("NM_1"))
    canonical = entry(own, F.lit("CANON"), F.lit("intron_variant"), blank, blank, F.when(_kind() == 2, "YES").otherwise(""), blank)
    picked = entry(own, F.lit("PICKED"), F.lit("intron_variant"), blank, F.when(_kind() == 1, "1").otherwise(""), blank, blank)
    text = F.concat_ws(",", wrong, canonical, mane, picked)
    return _effect_columns(inputs(spark, d).calls, cq.pick_csq(text, fields, c("ref"), c("alt"), c("alt_index"), c("n_alts")))


@query(
    "FN11_eff_pick",
    """SELECT sample_id, line_no, CASE k WHEN 0 THEN gene ELSE 'CODING' END AS gene, CASE k WHEN 0 THEN 'stop_gained' ELSE 'missense_variant' END AS consequence,
       CASE k WHEN 0 THEN 'p.Trp169Ter' ELSE 'p.Ala1Gly' END AS hgvs_p FROM (SELECT *, (line_no // 8000000) % 3 AS k FROM calls) x""",
)
def _(spark, d):
    def entry(effect, impact, change, gene, biotype, number):
        return F.concat(effect, F.lit("("), F.concat_ws("|", impact, F.lit("x"), F.lit("y"), change, F.lit("9"), gene, biotype, F.lit("CODING"), F.lit("T"), F.lit("2"), number), F.lit(")"))

    own = (c("alt_index") + 1).cast("string")
    high = F.when(_kind() == 0, "HIGH").otherwise("MODERATE")
    text = F.concat_ws(
        ",",
        F.lit("INTRON(MODIFIER|||)"),
        entry(F.lit("NON_SYNONYMOUS_CODING"), F.lit("MODERATE"), F.lit("A1G"), F.lit("CODING"), F.lit("protein_coding"), own),
        entry(F.lit("STOP_GAINED"), high, F.lit("W169*"), c("gene"), F.lit("nonsense"), own),
    )
    return _effect_columns(inputs(spark, d).calls, cq.pick_eff(text, c("alt_index"), c("n_alts")))


@query(
    "FN12_annotation_precedence",
    """SELECT sample_id, line_no, CASE k WHEN 0 THEN 'FROMANN' WHEN 1 THEN 'FROMEFF' ELSE gene END AS gene,
       CASE k WHEN 0 THEN 'stop_lost' WHEN 1 THEN 'stop_gained' ELSE consequence END AS consequence, CASE k WHEN 2 THEN hgvs_p END AS hgvs_p
       FROM (SELECT *, (line_no // 8000000) % 3 AS k FROM calls) x""",
)
def _(spark, d):
    ann = F.concat(c("alt"), F.lit("|stop_lost|HIGH|FROMANN|i|t|T|b|1/1|c.1|"))
    eff = F.lit("STOP_GAINED(HIGH|a|b|?|9|FROMEFF|protein_coding|CODING|T|2)")
    info = F.map_concat(
        F.create_map(F.lit("GENE"), c("gene"), F.lit("CSQ"), c("consequence"), F.lit("HGVSP"), c("hgvs_p"), F.lit("EFF"), F.when(_kind() < 2, eff).otherwise("")),
        F.create_map(F.lit("ANN"), F.when(_kind() == 0, ann).otherwise("broken")),
    )
    none = F.lit(None).cast("array<string>")
    return _effect_columns(inputs(spark, d).calls, cq.effect_of(info, none, c("ref"), c("alt"), c("alt_index"), c("n_alts")))


@query(
    "SRC5_info_fields",
    """SELECT key, value, count(*) AS n FROM (SELECT unnest(['GENE', 'DB', 'EXPR', 'Q']) AS key, unnest([gene, 'true', 'a=b=' || consequence, '2']) AS value FROM calls) x GROUP BY ALL""",
)
def _(spark, d):
    text = F.concat(F.lit("Q=1;GENE="), c("gene"), F.lit(";DB;EXPR=a=b="), c("consequence"), F.lit(";Q=2"))
    return (
        inputs(spark, d).calls.select(F.explode(nf.info_map(text)).alias("key", "value")).groupBy("key", "value").agg(rows("n"))
    )


@query(
    "FN13_to_FN17_carried_fields",
    """SELECT sample_id, line_no, k < 3 AS has_gnomad, CASE k WHEN 0 THEN CASE alt_index WHEN 0 THEN 0.25 ELSE 0.5 END WHEN 1 THEN 0.125 END AS gnomad_af,
         CASE k WHEN 1 THEN 7 END AS gnomad_ac, 0.9 AS revel, CASE WHEN k < 3 THEN 'Likely pathogenic, low penetrance' END AS clinvar_significance,
         CASE k WHEN 3 THEN NULL ELSE 0.6 END AS am_pathogenicity
       FROM (SELECT *, (line_no // 8000000) % 4 AS k FROM calls) x""",
)
def _(spark, d):
    kind = F.floor(c("line_no") / 8000000) % 4
    af = (
        F.when(kind == 0, "gnomad_AF=.;gnomAD_AF=0.25,0.5;CLNSIG=Likely_pathogenic,_low_penetrance;AlphaMissense=0.2&0.6&.")
        .when(kind == 1, "gnomad_AF=0.125;gnomad_AC=7;CLNSIG=Likely_pathogenic,_low_penetrance;am_pathogenicity=0.6")
        .when(kind == 2, "gnomad_AF=x,y,z;CLNSIG=Likely_pathogenic,_low_penetrance;am_pathogenicity=0.6")
        .otherwise("gnomad_AF=.;CLNSIG=.;am_pathogenicity=.")
    )
    text = F.concat(af, F.lit(";REVEL=.,0.4,0.9"))
    i = inputs(spark, d)
    stored = i.keep("carried_info", lambda: i.calls.select("sample_id", "line_no", "alt_index", nf.info_map(text).alias("info")))
    return stored.withColumn("v", nf.carried_annotation(c("info"), c("alt_index"))).select(
        "sample_id", "line_no", *[c(f"v.{x}").alias(x) for x in ("has_gnomad", "gnomad_af", "gnomad_ac", "revel", "clinvar_significance", "am_pathogenicity")]
    )


@query(
    "SRC7_frequency_sites",
    "SELECT chrom, pos, ref, alt, round(af, 6) AS af, round(af_grpmax, 6) AS af_grpmax, ac, an, nhomalt, round(faf95, 6) AS faf95, grpmax_pop FROM freq_store WHERE filter = 'PASS'",
)
def _(spark, d):
    item = lambda key, value: F.concat(F.lit(key + "="), F.coalesce(value.cast("string"), F.lit(".")))
    info = F.concat_ws(
        ";", item("AF_joint", c("af")), item("AF_grpmax_joint", c("af_grpmax")), item("AC_joint", c("ac")), item("AN_joint", c("an")),
        item("nhomalt_joint", c("nhomalt")), item("fafmax_faf95_max_joint", c("faf95")), item("grpmax_joint", c("grpmax_pop")),
    )
    store = inputs(spark, d).relation("freq_store")
    lines = as_lines(store, tabbed("chrom", c("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", info))
    r = lambda name: F.round(name, 6).alias(name)
    return so.frequency_sites(lines).select("chrom", "pos", "ref", "alt", r("af"), r("af_grpmax"), "ac", "an", "nhomalt", r("faf95"), "grpmax_pop")


@query(
    "SRC8_assertion_records",
    """SELECT chrom, pos, ref, alt, significance, replace(review_status, '_', ' ') AS review_status, accession, condition,
       CASE WHEN review_status LIKE 'practice%' THEN 4 WHEN review_status LIKE 'reviewed%' THEN 3 WHEN review_status LIKE '%multiple%' THEN 2
         WHEN review_status LIKE 'criteria%' THEN 1 ELSE 0 END AS review_stars FROM assertion_store WHERE significance <> ''""",
)
def _(spark, d):
    store = inputs(spark, d).relation("assertion_store")
    info = F.concat(
        F.lit("ALLELEID=1"), F.when(c("significance") != "", F.concat(F.lit(";CLNSIG="), F.translate("significance", " ", "_"))).otherwise(""),
        F.lit(";CLNREVSTAT="), c("review_status"), F.lit(";CLNDN="), F.translate("condition", " ", "_"),
    )
    line = tabbed(K.bare_contig(c("chrom")), c("pos").cast("string"), "accession", F.lower("ref"), F.lower("alt"), F.lit("."), F.lit("."), info)
    return so.assertion_records(as_lines(store, line)).drop("line_no")


@query("SRC9_missense_scores", "SELECT chrom, pos, ref, alt, 'T' || transcript_no AS transcript_id, am_pathogenicity, am_class FROM score_rows")
def _(spark, d):
    scores = inputs(spark, d).relation("score_rows")
    line = tabbed("chrom", c("pos").cast("string"), "ref", "alt", F.lit("hg38"), F.lit("P1"), F.concat(F.lit("T"), "transcript_no"), F.lit("A1G"), c("am_pathogenicity").cast("string"), "am_class")
    comment = scores.select("am_class").distinct().select(F.concat(F.lit("# licence "), "am_class").alias("value"))
    lines = as_lines(scores, line).unionByName(as_lines(comment, c("value")))
    return so.missense_scores(lines).select("chrom", "pos", "ref", "alt", "transcript_id", "am_pathogenicity", "am_class")


@query(
    "SRC10_exon_intervals",
    """SELECT chrom, start, "end", count(*) AS n FROM (SELECT 'chr' || (1 + p_partkey % 22) AS chrom, p_partkey * 100 AS start, p_partkey * 100 + 50 + p_size AS "end"
       FROM part WHERE p_partkey % 3 = 0) x GROUP BY ALL""",
)
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    tags = F.when(c("p_partkey") % 3 == 0, "ID=e;tag=basic,MANE_Select").otherwise("ID=e;gene_type=protein_coding")
    contig = F.concat(F.lit("chr"), (c("p_partkey") % 22 + 1).cast("string"))
    line = tabbed(contig, F.lit("HAVANA"), F.lit("exon"), (c("p_partkey") * 100 + 1).cast("string"), (c("p_partkey") * 100 + 50 + c("p_size")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), tags)
    gene = F.regexp_replace(line, "\texon\t", "\tgene\t")
    lines = as_lines(part, line).unionByName(as_lines(part, gene)).unionByName(as_lines(part, F.regexp_replace(line, "^chr[0-9]+", "chrUn")))
    return si.exon_intervals(lines).groupBy("chrom", "start", "end").agg(rows("n"))


@query("SRC11_ontology", "SELECT child AS term, parent FROM is_a")
def _(spark, d):
    i = inputs(spark, d)
    parents = i.relation("is_a").groupBy("child").agg(F.collect_list(F.concat(F.lit("is_a: HP:"), "parent", F.lit(" ! label"))).alias("lines"))
    stanza = F.concat(F.lit("[Term]\nid: HP:"), c("child"), F.lit("\nname: label of "), c("child"), F.lit("\n"), F.array_join("lines", "\n"))
    live = parents.select(stanza.alias("value"))
    dropped = parents.select(F.concat(stanza, F.lit("\nis_obsolete: true")).alias("value")).unionByName(
        parents.select(F.concat(F.lit("[Typedef]\nid: HP:"), "child").alias("value"))
    )
    edges = on.is_a_edges(on.parse_obo(live.unionByName(dropped)))
    return edges.select(F.substr("child", F.lit(4)).alias("term"), F.substr("parent", F.lit(4)).alias("parent"))


@query("SRC12_bed", 'SELECT chrom, start, "end", count(*) AS n FROM regions GROUP BY ALL')
def _(spark, d):
    regions = inputs(spark, d).relation("regions")
    text = lambda name: c(name).cast("string")
    good = as_lines(regions, tabbed(K.bare_contig(c("chrom")), text("start"), text("end"), F.lit("name")))
    bad = as_lines(regions, F.concat(F.lit("track name="), "chrom")).unionByName(as_lines(regions, tabbed("chrom", F.lit("x"), text("end"))))
    return si.bed_intervals(good.unionByName(bad)).groupBy("chrom", "start", "end").agg(rows("n"))


def _packets(i):
    """One case packet per case: a listed and an excluded term, a located and an unlocated variant."""
    cases = i.relation("cases").withColumn("zygosity", F.when(c("case_no") % 3 == 0, "hom").when(c("case_no") % 3 == 1, "het"))
    term = F.concat(F.lit("HP:"), c("gene"))
    feature = lambda identifier, excluded: F.struct(F.struct(identifier.alias("id")).alias("type"), F.lit(excluded).alias("excluded"))
    state = F.struct(
        F.when(c("zygosity") == "hom", "GENO:0000136").alias("id"), F.when(c("zygosity") == "het", "Heterozygous").alias("label")
    )
    located = F.struct(
        F.struct(c("gene").alias("symbol")).alias("geneContext"),
        F.array(F.struct(F.lit("hgvs.p").alias("syntax"), F.lit("p.(A;1)=x").alias("value"))).alias("expressions"),
        F.struct("chrom", c("pos").cast("string").alias("pos"), "ref", "alt").alias("vcfRecord"), state.alias("allelicState"),
    )
    missing = F.struct(located["geneContext"].alias("geneContext"), located["expressions"].alias("expressions"),
                       F.struct("chrom", F.lit(None).cast("string").alias("pos"), "ref", "alt").alias("vcfRecord"), state.alias("allelicState"))
    wrap = lambda v: F.struct(F.struct(v.alias("variationDescriptor")).alias("variantInterpretation"))
    packet = F.struct(
        F.struct(c("case_id").alias("id")).alias("subject"),
        F.array(feature(term, False), feature(F.lit("HP:9"), True), feature(F.lit("MONDO:1"), False)).alias("phenotypicFeatures"),
        F.array(F.struct(F.struct(F.struct(F.when(c("case_no") % 2 == 0, "named disease").alias("label")).alias("disease"), F.array(wrap(located), wrap(missing)).alias("genomicInterpretations")).alias("diagnosis"))).alias("interpretations"),
        F.array(F.struct(F.struct(F.lit("fallback disease").alias("label")).alias("term"))).alias("diseases"),
    )
    return pk.parse_phenopackets(cases.select(c("case_id").alias("file"), F.to_json(packet).alias("value")))


@query(
    "SRC13_phenopackets",
    """SELECT case_id AS subject_id, 'HP:' || gene AS terms, CASE WHEN case_no % 2 = 0 THEN 'named disease' ELSE 'fallback disease' END AS disease, 1 AS skipped_variants,
       chrom, pos, ref, alt, gene, 'p.(A;1)=x' AS hgvs_p, CASE case_no % 3 WHEN 0 THEN 'hom' WHEN 1 THEN 'het' END AS zygosity FROM cases""",
)
def _(spark, d):
    packets = _packets(inputs(spark, d))
    return packets.select("subject_id", F.array_join("hpo_terms", ",").alias("terms"), "disease", "skipped_variants", F.explode("variants").alias("v")).select(
        "subject_id", "terms", "disease", "skipped_variants", *[c(f"v.{x}").alias(x) for x in ("chrom", "pos", "ref", "alt", "gene", "hgvs_p", "zygosity")]
    )


@query(
    "SNK7_packet_vcf_lines",
    """SELECT case_id AS subject_id, replace(chrom, 'chr', '') || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '800' || chr(9) || 'PASS' || chr(9) ||
       'GENE=' || gene || ';HGVSP=p.(A|1)_x' || chr(9) || 'GT' || chr(9) || CASE case_no % 3 WHEN 0 THEN '1/1' ELSE '0/1' END AS value FROM cases""",
)
def _(spark, d):
    return sk.packet_vcf_lines(pk.packet_variants(_packets(inputs(spark, d)))).select("subject_id", "value")


@query(
    "SNK6_annotated_vcf_lines",
    """SELECT sample_id, line_no, chrom || chr(9) || pos || chr(9) || coalesce(variant_id, '.') || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || filter_status || chr(9) ||
         concat_ws(';', 'gnomad_AF=' || printf('%g', gnomad_af), 'gnomad_AC=' || gnomad_ac, 'gnomad_AN=' || gnomad_an, 'gnomad_nhomalt=' || gnomad_homozygotes, 'gnomad_faf95=' || printf('%g', gnomad_faf95),
           'CLNSIG=' || replace(clinvar_significance, ' ', '_'), 'CLNREVSTAT=' || clinvar_review_status, 'CLNDN=' || replace(clinvar_condition, ' ', '_'), 'CLNVI=' || clinvar_accession,
           'am_pathogenicity=' || printf('%g', am_pathogenicity), 'GENE=' || gene) || chr(9) || 'GT' || chr(9) || CASE zygosity WHEN 'het' THEN '0/1' WHEN 'hom' THEN '1/1' ELSE '1' END AS value FROM found""",
)
def _(spark, d):
    found = inputs(spark, d).found.withColumn("info_text", F.concat(F.lit("GENE="), "gene"))
    return sk.annotated_vcf_lines(found)


@query("SRC14_keyed_tables", "SELECT key, round(af, 9) AS af, revel, cadd FROM local_freq FULL JOIN predictors USING (key)")
def _(spark, d):
    i = inputs(spark, d)
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    local = as_lines(i.relation("local_freq"), F.concat_ws(TAB, "key", text("af"), F.lit("3"), F.lit("9")), line_no=F.lit(2).cast("bigint"))
    older = as_lines(i.relation("local_freq"), F.concat_ws(TAB, "key", F.lit("0.9")), line_no=F.lit(1).cast("bigint"))
    predictors = as_lines(i.relation("predictors"), F.concat_ws(TAB, "key", text("revel"), text("cadd")))
    noise = as_lines(i.relation("cases"), F.concat(F.lit("# "), "case_id")).unionByName(as_lines(i.relation("cases"), F.lit("")))
    frequencies = tb.local_frequencies(local.unionByName(older).unionByName(noise))
    joined = frequencies.join(tb.predictor_scores(predictors.unionByName(noise)), "key", "full")
    return joined.select("key", F.round("af", 9).alias("af"), "revel", "cadd")


@query(
    "SRC14_gene_constraint",
    "SELECT gene, pli, loeuf, coalesce(pli >= 0.9, false) OR coalesce(loeuf < 0.35, false) AS lof_intolerant FROM gene_constraint",
)
def _(spark, d):
    i = inputs(spark, d)
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    header = as_lines(i.relation("gene_constraint"), F.lit("gene\tpLI\tLOEUF"))
    return tb.gene_constraint(header.unionByName(as_lines(i.relation("gene_constraint"), F.concat_ws(TAB, "gene", text("pli"), text("loeuf")))))


@query("SRC14_gene_list", "SELECT DISTINCT upper(gene) AS gene FROM haploinsufficient")
def _(spark, d):
    listed = inputs(spark, d).relation("haploinsufficient")
    return tb.gene_list(as_lines(listed, F.concat(c("gene"), F.lit(" "))).unionByName(as_lines(listed, F.concat(F.lit("#"), "gene"))))


@query("SRC15_json_snapshot", "SELECT key, round(af, 9) AS af, round(faf95, 9) AS faf95, hom FROM frozen_freq")
def _(spark, d):
    frozen = inputs(spark, d).relation("frozen_freq")
    document = F.to_json(F.create_map(c("key"), F.struct("af", "faf95", "hom")))
    table = tb.keyed_snapshot(frozen.select(document.alias("value")), tb.FREQUENCY_SNAPSHOT)
    return table.select("key", F.round("af", 9).alias("af"), F.round("faf95", 9).alias("faf95"), "hom")


@query("SRC16_release_pairs", "SELECT gene, term, 'first' AS name FROM phenotype_terms")
def _(spark, d):
    pairs = inputs(spark, d).relation("phenotype_terms")
    line = lambda name: F.concat_ws(TAB, F.lit("101"), "gene", "term", F.lit(name), F.lit("OMIM:1"))
    header = as_lines(pairs, F.lit("ncbi_gene_id\tgene_symbol\thpo_id\thpo_name"))
    first = as_lines(pairs, line("first"), line_no=F.lit(1).cast("bigint"))
    later = as_lines(pairs, line("later"), line_no=F.lit(2).cast("bigint"))
    return on.gene_terms_from_release(header.unionByName(later).unionByName(first))


@query("SRC17_constraint_release", "SELECT gene, pli, loeuf FROM gene_constraint")
def _(spark, d):
    table = inputs(spark, d).relation("gene_constraint")
    first = table.select("gene", c("pli").cast("string").alias("pLI"), c("loeuf").cast("string").alias("oe_lof_upper"), F.lit(1).alias("line_no"))
    other = first.withColumns({"pLI": F.lit("0.5"), "oe_lof_upper": F.lit("NA"), "line_no": F.lit(2)})
    return tb.constraint_release(first.unionByName(other))


@query(
    "SRC18_patient_terms", "SELECT sample_id, term, count(*) AS n FROM patient_terms GROUP BY ALL",
)
def _(spark, d):
    listed = inputs(spark, d).patient_terms
    good = as_lines(listed, F.concat(F.lit("  "), c("term"), F.lit(" some label")), c("sample_id"))
    noise = as_lines(listed, F.concat(F.lit("# "), c("term")), c("sample_id"))
    return on.listed_terms(good.unionByName(noise)).groupBy(c("file").alias("sample_id"), "term").agg(rows("n"))


@query("SRC18_inline_terms", "SELECT o_custkey AS k, 'HP:' || o_orderkey || ',HP:7' AS terms FROM orders")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.concat(F.lit("terms hp:"), c("o_orderkey").cast("string"), F.lit("; Hp:7 and HPX:3"))
    return orders.select(c("o_custkey").alias("k"), F.array_join(on.inline_terms(text), ",").alias("terms"))


@query(
    "SRC19_manifest_terms",
    """SELECT case_id, CASE WHEN case_no % 4 <> 0 THEN t END AS term, count(*) AS n FROM (SELECT case_id, case_no, unnest(CASE WHEN case_no % 4 = 0 THEN ['x'] ELSE [gene, consequence] END) AS t FROM cases) x GROUP BY ALL""",
)
def _(spark, d):
    listed = F.when(c("case_no") % 4 == 0, " , ").otherwise(F.concat(c("gene"), F.lit(" ,"), c("consequence"), F.lit(",")))
    manifest = inputs(spark, d).relation("cases").select("case_id", listed.alias("hpo"))
    return tb.manifest_terms(manifest).groupBy("case_id", "term").agg(rows("n"))


@query(
    "SRC20_target_gene_assertions",
    """SELECT gene, pos, consequence, nullv AS is_null_variant FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN nullv THEN 0 ELSE 1 END, pos, alt, ref) AS rn FROM (
         SELECT 'GENE' || (CAST(substr(accession, 4) AS BIGINT) % 150) AS gene, pos, ref, alt, CASE WHEN CAST(substr(accession, 4) AS BIGINT) % 2 = 0 THEN 'stop_gained' ELSE 'missense_variant' END AS consequence,
           CAST(substr(accession, 4) AS BIGINT) % 2 = 0 AS nullv FROM assertion_store WHERE significance IN ('Pathogenic', 'Likely pathogenic')) a) b WHERE rn = 1""",
)
def _(spark, d):
    i = inputs(spark, d)
    number = F.substr("accession", F.lit(4)).cast("bigint")
    gene = F.concat(F.lit("GENE"), (number % 150).cast("string"))
    terms = F.when(number % 2 == 0, "SO:1|missense_variant,SO:2|nonsense").otherwise("SO:1|missense_variant")
    info = F.concat(F.lit("GENEINFO="), gene, F.lit(":12|X:3;MC="), terms, F.lit(";CLNSIG="), F.translate("significance", " ", "_"))
    line = tabbed("chrom", c("pos").cast("string"), "accession", "ref", "alt", F.lit("."), F.lit("."), info)
    genes = i.calls.select("gene").distinct()
    found = so.target_gene_assertions(as_lines(i.relation("assertion_store"), line), genes).withColumn("milder", ~c("is_null_variant"))
    return first_per_key(found, ["gene"], ["milder", "pos", "alt", "ref"]).select("gene", "pos", "consequence", "is_null_variant")


_REGION_HIT = 'EXISTS (SELECT 1 FROM merged_regions m WHERE m.chrom = x.chrom AND x.pos - 1 >= m.start AND x.pos - 1 < m."end")'


def _merged(i):
    from locusflow.operators.intervals import merge_intervals

    return merge_intervals(i.relation("regions"))


def _joint_lines(i):
    """A two-sample file per sample of the calls: a carrier column and a non-carrier column."""
    info = F.concat(
        F.lit("AF=0.5,0.25;AC=5,6;AN=10,10;nhomalt=0,0;gnomad_AF_popmax="), F.when(c("line_no") % 2 == 0, "0.125,0.0625").otherwise(".,."),
        F.lit(";gnomad_AC_popmax=3,4;gnomad_AN_popmax=30,40;gnomad_nhomalt_popmax=1,2;gnomad_popmax=afr,nfe;vep=C|x|GENEX|2,T|y|GENEY|1"),
    )
    line = tabbed("chrom", c("pos").cast("string"), F.lit("."), "ref", F.concat("alt", F.lit(",TTTT")), F.lit("."), "filter_status", info,
                  F.lit("GT:AD:DP:GQ"), F.lit("0|1:8,9,1:18:50"), F.lit("0/0:20,0,0:20:60"), F.lit("2/2:0,1,7:8:30"))
    header = i.calls.select("sample_id").distinct().select(
        c("sample_id").alias("file"), F.lit(-1).cast("bigint").alias("line_no"), F.lit(COLUMNS + "A\tB\tC").alias("value")
    )
    return i.keep("joint_lines", lambda: header.unionByName(as_lines(i.calls, line, c("sample_id"), c("line_no"))))


@query(
    "SRC21_joint_carriers",
    f"""SELECT sample_id AS file, line_no, s.sample_id, CASE s.sample_id WHEN 'A' THEN alt ELSE 'TTTT' END AS alt, s.v AS sample_value,
        CASE WHEN line_no % 2 = 0 THEN CASE s.sample_id WHEN 'A' THEN 'gnomad_AF=0.125;gnomad_AC=3;gnomad_AN=30;gnomad_nhomalt=1;gnomad_popmax=afr' ELSE 'gnomad_AF=0.0625;gnomad_AC=4;gnomad_AN=40;gnomad_nhomalt=2;gnomad_popmax=nfe' END
          ELSE CASE s.sample_id WHEN 'A' THEN 'gnomad_AF=0.5;gnomad_AC=5;gnomad_AN=10;gnomad_nhomalt=0;gnomad_popmax=hgdp_tgp' ELSE 'gnomad_AF=0.25;gnomad_AC=6;gnomad_AN=10;gnomad_nhomalt=0;gnomad_popmax=hgdp_tgp' END END
        || CASE s.sample_id WHEN 'A' THEN ';CSQ=T|y|GENEY|1' ELSE ';CSQ=C|x|GENEX|1' END AS info_text
        FROM (SELECT * FROM calls x WHERE {_REGION_HIT}) k, (VALUES ('A', '0/1:18:50:8,9'), ('C', '1/1:8:30:0,7')) s(sample_id, v)""".replace("SELECT sample_id AS file", "SELECT k.sample_id AS file"),
)
def _(spark, d):
    i = inputs(spark, d)
    carriers = jt.joint_carriers(_joint_lines(i), _merged(i), ["Allele", "Consequence", "SYMBOL", "ALLELE_NUM"])
    return carriers.select("file", "line_no", "sample_id", "alt", "sample_value", "info_text")


@query(
    "SRC22_passing_carriers",
    f"""SELECT k.sample_id AS file, line_no, s.sample_id, CASE s.sample_id WHEN 'A' THEN alt ELSE 'TTTT' END AS alt, s.v AS sample_value
        FROM (SELECT * FROM calls x WHERE filter_status = 'PASS' AND {_REGION_HIT}) k, (VALUES ('A', '0/1:18:50:8,9'), ('C', '1/1:8:30:0,7')) s(sample_id, v)""",
)
def _(spark, d):
    i = inputs(spark, d)
    return jt.passing_carriers(_joint_lines(i), _merged(i)).select("file", "line_no", "sample_id", "alt", "sample_value")


@query(
    "SRC4_joint_samples",
    """SELECT k.sample_id AS file, line_no, s.sample_id, CASE s.sample_id WHEN 'A' THEN alt ELSE 'TTTT' END AS alt, s.z AS zygosity, s.dp AS depth, s.gq, s.ab AS allele_balance, s.i AS alt_index, 2 AS n_alts
       FROM calls k, (VALUES ('A', 'het', 18, 50, 0.5, 0), ('C', 'hom', 8, 30, 0.875, 1)) s(sample_id, z, dp, gq, ab, i)""",
)
def _(spark, d):
    parsed = vcf.parse_calls(_joint_lines(inputs(spark, d)), all_samples=True, carriers_only=True)
    return parsed.select("file", "line_no", "sample_id", "alt", "zygosity", "depth", "gq", "allele_balance", "alt_index", "n_alts")


@query(
    "SRC4_joint_sample_rows",
    """SELECT s.sample_id, a.alt_index, count(*) AS n, count(*) FILTER (WHERE (s.sample_id = 'A' AND a.alt_index = 0) OR (s.sample_id = 'C' AND a.alt_index = 1)) AS n_carried
       FROM calls k, (VALUES ('A'), ('B'), ('C')) s(sample_id), (VALUES (0), (1)) a(alt_index) GROUP BY ALL""",
)
def _(spark, d):
    parsed = vcf.parse_calls(_joint_lines(inputs(spark, d)), all_samples=True)
    return parsed.groupBy("sample_id", "alt_index").agg(rows("n"), F.count("zygosity").alias("n_carried"))


@query("FLT6_joint_sample_choice", "SELECT DISTINCT sample_id AS file, 3 AS n_samples, true AS defaulted_to_first FROM calls")
def _(spark, d):
    return sel.sample_choice_warning(vcf.file_headers(_joint_lines(inputs(spark, d))), None)


def _records(i):
    """One assertion document per part row, with the allele in the location, in the SPDI, or in neither."""
    store = i.relation("assertion_store").withColumn("n", F.substr("accession", F.lit(4)).cast("bigint"))
    bare = K.bare_contig(c("chrom"))
    here = c("n") % 3 == 0
    location = F.struct(
        F.lit("GRCh38").alias("assembly_name"), bare.alias("chr"), c("pos").cast("string").alias("start"),
        F.when(here, c("ref")).alias("ref"), F.when(here, c("alt")).alias("alt"),
    )
    old = F.struct(F.lit("GRCh37").alias("assembly_name"), bare.alias("chr"), F.lit("1").alias("start"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    spdi = F.when(c("n") % 3 == 1, F.concat(F.lit("NC:1:"), "ref", F.lit(":"), "alt"))
    kind = F.struct(F.when(c("significance") != "", c("significance")).alias("description"), c("review_status").alias("review_status"),
                    F.array(F.struct(c("condition").alias("trait_name")), F.struct(F.lit("second").alias("trait_name"))).alias("trait_set"))
    terms = F.when(c("n") % 4 == 0, F.array(F.lit("5 prime UTR variant"), F.lit("missense variant"), F.lit("nonsense")))
    title = F.when(c("n") % 4 == 1, "NM_1(G):c.1del (p.Ala3fs)").when(c("n") % 4 == 2, "NM_1(G):c.1C>T (p.Arg5Ter)").otherwise("NM_1(G):c.1C>T (p.Ala7Val)")
    document = F.struct(
        c("accession"), title.alias("title"), F.array(F.struct(spdi.alias("canonical_spdi"), F.array(old, location).alias("variation_loc"))).alias("variation_set"),
        F.when(c("n") % 2 == 0, kind).alias("germline_classification"), F.when(c("n") % 2 == 1, kind).alias("clinical_significance"), terms.alias("molecular_consequence_list"),
    )
    return rec.parse_records_json(store.select("chrom", "pos", "ref", "alt", "n", F.to_json(document).alias("value")))


_ASSERTED = "(SELECT *, CAST(substr(accession, 4) AS BIGINT) AS n FROM assertion_store)"


@query(
    "FN29_record_consequence",
    f"SELECT accession, CASE n % 4 WHEN 0 THEN 'stop_gained' WHEN 1 THEN 'frameshift_variant' WHEN 2 THEN 'stop_gained' ELSE '' END AS consequence FROM {_ASSERTED} x",
)
def _(spark, d):
    return _records(inputs(spark, d)).select("accession", cq.most_severe_record_consequence(c("molecular_consequence_list"), c("title")).alias("consequence"))


@query(
    "FN30_simple_snv",
    f"""SELECT accession, CASE WHEN n % 3 <> 2 AND length(ref) = 1 THEN replace(chrom, 'chr', '') || '-' || pos || '-' || ref || '-' || alt END AS key,
        CASE n % 4 WHEN 1 THEN 'p.Ala3fs' WHEN 2 THEN 'p.Arg5Ter' ELSE 'p.Ala7Val' END AS hgvs_p FROM {_ASSERTED} x""",
)
def _(spark, d):
    return _records(inputs(spark, d)).select("accession", rec.simple_snv_key(c("variation_set")).alias("key"), cq.protein_change_from_title(c("title")).alias("hgvs_p"))


@query(
    "FN31_allele_confirmation",
    f"SELECT accession, n % 3 <> 2 AS confirmed, false AS confirmed_other, nullif(significance, '') AS significance, review_status, CASE WHEN n % 2 = 0 THEN condition || '; second' END AS condition FROM {_ASSERTED} x",
)
def _(spark, d):
    confirm = lambda alt: rec.confirms_allele(c("variation_set"), c("chrom"), c("pos"), c("ref"), alt)
    found = rec.record_fields(_records(inputs(spark, d)))
    return found.select("accession", confirm(c("alt")).alias("confirmed"), confirm(F.lit("TTTTT")).alias("confirmed_other"), "significance", "review_status", "condition")


@query(
    "FN32_contig_list",
    "SELECT chrom, count(*) AS n FROM calls WHERE chrom IN ('chr1', 'chr2', 'chr3', 'chr20') GROUP BY chrom",
)
def _(spark, d):
    wanted = [f"chr{x}" for x in K.contig_list("1-3,20,X")]
    return inputs(spark, d).calls.where(c("chrom").isin(*wanted)).groupBy("chrom").agg(rows("n"))


@query(
    "AGG22_file_inventory",
    """SELECT sample_id AS file, count(*) AS total_variants, count(*) FILTER (WHERE filter_status = 'PASS') AS pass_filter, count(*) AS with_consequence, 1.0 AS consequence_coverage,
       true AS annotated, 'consequence' AS annotation_source, 'CSQ,DB,GENE,HGVSC,HGVSP,TRANSCRIPT' AS info_fields, 'CSQ' AS annotation_fields FROM calls GROUP BY sample_id""",
)
def _(spark, d):
    inventory = hl.file_inventory(vcf.parse_calls(stored_call_lines(inputs(spark, d))))
    return inventory.withColumns({x: F.array_join(x, ",") for x in ("info_fields", "annotation_fields")})


@query(
    "CB10_available_criteria",
    """SELECT file, criteria, status FROM (SELECT DISTINCT sample_id AS file, CAST(substr(sample_id, 2) AS BIGINT) % 2 AS odd FROM calls) s, (VALUES ('PVS1', 'available'), ('PM4', 'available'), ('PP3 / BP4', 'limited'),
       ('PM2 / BA1 / BS1', 'available'), ('PS1 / PM5 / PP5 / BP6', 'available'), ('PP4', 'limited'), ('PS2 / PM3 / PM6 / PP1 / BS4', 'na'), ('build warning', 'limited')) v(criteria, status)
       WHERE criteria <> 'build warning' OR odd = 1""",
)
def _(spark, d):
    lines = stored_call_lines(inputs(spark, d))
    inventory = hl.file_inventory(vcf.parse_calls(lines))
    return hl.available_criteria(inventory, vcf.file_headers(lines), {"gnomad", "clinvar", "hpo"}, phenotype_given=False)
