"""Saved answers of public services, flattened into tables.

Inputs are rows with one JSON document each (``payload``), as a directory of
saved answers is read; nothing here opens a connection.  Nested objects stay
as JSON text in ``raw``; lists become rows with their place.  Tables are not
cut: ``capped`` makes the visible part of one and says what it left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def at(doc: Column | str, path: str) -> Column:
    """Value at a JSON path as text; null where it is not there."""
    return F.get_json_object(T.col(doc), "$." + path)


def listed(doc: Column | str, path: str) -> Column:
    """A JSON list as an array of JSON texts; anything else is empty."""
    return F.coalesce(F.from_json(at(doc, path), "array<string>"), F.array().cast("array<string>"))


def unnested(df: DataFrame, doc: str, path: str, place: str, item: str) -> DataFrame:
    """One row for each element of a list inside ``doc``, with its place."""
    return df.select("*", F.posexplode(listed(doc, path)).alias(place, item))


def capped(df: DataFrame, most: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows, and one row ``(row_count, upstream_row_count, truncated)``."""
    n = df.agg(F.count("*").alias("upstream_row_count"))
    return df.orderBy(*order).limit(most), n.select(F.least(F.col("upstream_row_count"), F.lit(most)).alias("row_count"), "upstream_row_count", (F.col("upstream_row_count") > most).alias("truncated"))


def raw_fields(df: DataFrame, doc: str = "payload") -> DataFrame:
    """One row ``fields``: the sorted union of the top-level keys of all documents."""
    keys = df.select(F.explode(F.json_object_keys(doc)).alias("k")).distinct()
    return keys.agg(F.array_sort(F.collect_set("k")).alias("fields"))  # names of columns


def trials(payloads: DataFrame) -> dict[str, DataFrame]:
    """Six tables of trial records: studies, conditions, interventions, eligibilities, outcomes, outcome_measurements.

    ``results_status`` is ``inconsistent`` where the flag and the section disagree.
    """
    doc = F.col("payload")
    base = payloads.select(at(doc, "protocolSection.identificationModule.nctId").alias("nct_id"), doc.alias("raw"))
    has, section = at("raw", "hasResults"), at("raw", "resultsSection").isNotNull()
    status = F.when((has == "true") & section, "available").when((has == "false") & ~section, "not_reported").otherwise("inconsistent")
    rows = lambda path, place, item="raw_item": unnested(base, "raw", path, place, item).drop("raw").withColumnRenamed(item, "raw")
    outcomes = None
    for kind, key in (("primary", "primaryOutcomes"), ("secondary", "secondaryOutcomes"), ("other", "otherOutcomes")):
        x = rows(f"protocolSection.outcomesModule.{key}", "outcome_index").withColumn("outcome_type", F.lit(kind))
        outcomes = x if outcomes is None else outcomes.unionByName(x)
    m = unnested(base, "raw", "resultsSection.outcomeMeasuresModule.outcomeMeasures", "measure_index", "measure").drop("raw")
    m = unnested(m, "measure", "classes", "class_index", "class")
    m = unnested(m, "class", "categories", "category_index", "category")
    m = unnested(m, "category", "measurements", "measurement_index", "measurement")
    return {
        "studies": base.select("nct_id", at("raw", "protocolSection.identificationModule.briefTitle").alias("title"), status.alias("results_status"), "raw"),
        "conditions": rows("protocolSection.conditionsModule.conditions", "condition_index").withColumnRenamed("raw", "condition"),
        "interventions": rows("protocolSection.armsInterventionsModule.interventions", "intervention_index").withColumns({"name": at("raw", "name"), "type": at("raw", "type")}),
        "eligibilities": base.select("nct_id", at("raw", "protocolSection.eligibilityModule").alias("raw")).filter("raw is not null").withColumns({"sex": at("raw", "sex"), "minimum_age": at("raw", "minimumAge")}),
        "outcomes": outcomes.withColumn("measure", at("raw", "measure")),
        "outcome_measurements": m.select("nct_id", "measure_index", "class_index", "category_index", "measurement_index", at("measure", "type").alias("outcome_type"), at("measure", "title").alias("outcome_title"), at("class", "title").alias("class_title"), at("category", "title").alias("category_title"), at("measurement", "groupId").alias("group_id"), at("measurement", "value").alias("value"), F.col("measurement").alias("raw")),
    }


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each non-null key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("x")).select(key, "x.*")


def evidence(payloads: DataFrame) -> dict[str, DataFrame]:
    """Nine tables of evidence items: items, diseases, molecular_profiles, variants, genes, therapies, sources, relations, and links.

    Entities are kept once by id, as they come first (``ord``, then their
    place).  Genes of fusions are both partners and those known besides.
    """
    e = payloads.select("ord", at("payload", "id").cast("long").alias("evidence_id"), F.col("payload").alias("raw"))
    part = lambda path, key: first_of_each(e.select("ord", at("raw", f"{path}.id").cast("long").alias(key), at("raw", f"{path}.name").alias("name"), at("raw", path).alias("raw_entity")), key, ["ord"]).drop("ord")
    v = unnested(e, "raw", "molecularProfile.variants", "variant_index", "variant").select("ord", "evidence_id", "variant_index", at("variant", "id").cast("long").alias("variant_id"), at("variant", "name").alias("name"), at("variant", "feature").alias("feature"))
    fusion = at("feature", "featureInstance.__typename") == "Fusion"
    partners = F.concat(F.array_compact(F.array(at("feature", "featureInstance.fivePrimeGene"), at("feature", "featureInstance.threePrimeGene"))), listed("feature", "featureInstance.knownPartnerGenes"))
    of_gene = F.when(at("feature", "featureType") == "GENE", F.array("feature")).when(fusion, partners).otherwise(F.array().cast("array<string>"))
    g = v.select("ord", "evidence_id", "variant_index", F.posexplode(of_gene).alias("gene_index", "gene")).select("ord", "evidence_id", "variant_index", "gene_index", at("gene", "id").cast("long").alias("gene_id"), at("gene", "name").alias("symbol"), F.coalesce(at("gene", "entrezId"), at("gene", "featureInstance.entrezId")).cast("long").alias("entrez_id"))
    t = unnested(e, "raw", "therapies", "therapy_index", "therapy").select("ord", "evidence_id", "therapy_index", at("therapy", "id").cast("long").alias("therapy_id"), at("therapy", "name").alias("name"))
    ids = lambda df, key, *order: df.groupBy("evidence_id", key).agg(F.min(F.struct(*order)).alias("o")).groupBy("evidence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", key))), lambda x: x[key]).alias(f"{key}s"))
    relations = e.select("evidence_id", at("raw", "disease.id").cast("long").alias("disease_id"), at("raw", "molecularProfile.id").cast("long").alias("profile_id"), at("raw", "source.id").cast("long").alias("source_id"), at("raw", "source.citationId").alias("publication_id"))
    for df, key, order in ((g, "gene_id", ["variant_index", "gene_index"]), (v, "variant_id", ["variant_index"]), (t, "therapy_id", ["therapy_index"])):
        relations = relations.join(ids(df, key, *order), "evidence_id", "left")
    return {
        "items": e.select("evidence_id", at("raw", "status").alias("status"), at("raw", "evidenceLevel").alias("level"), "raw"), "diseases": part("disease", "disease_id"), "molecular_profiles": part("molecularProfile", "profile_id"),
        "variants": first_of_each(v.drop("evidence_id"), "variant_id", ["ord", "variant_index"]).drop("ord", "variant_index"), "genes": first_of_each(g.drop("evidence_id"), "gene_id", ["ord", "variant_index", "gene_index"]).select("gene_id", "symbol", "entrez_id"),
        "therapies": first_of_each(t.drop("evidence_id"), "therapy_id", ["ord", "therapy_index"]).select("therapy_id", "name"), "sources": part("source", "source_id"), "relations": relations,
    }


def cell_lines(models: DataFrame, sensitivity: DataFrame | None = None, drug: str | None = None, lineage: str = "breast|乳腺") -> DataFrame:
    """Cell lines of a lineage with the last sensitivity row of each model.

    ``models(ModelID, CellLineName, OncotreeLineage)``, ``sensitivity(ModelID,
    Drug, AUC, IC50, ord)``.  Models without id or name are left out.
    """
    m = models.filter(T.fold("OncotreeLineage").rlike(lineage)).select(F.trim("ModelID").alias("model_id"), F.coalesce(F.when(F.trim("CellLineName") != "", F.trim("CellLineName")), F.trim("ModelID")).alias("cell_line_name"), F.col("OncotreeLineage").alias("lineage")).filter("model_id <> ''")
    if sensitivity is None:
        m = m.withColumns({"drug": F.lit(drug), "auc": F.lit(None).cast("double"), "ic50": F.lit(None).cast("double")})
    else:
        last = sensitivity.groupBy(F.col("ModelID").alias("model_id")).agg(F.max_by(F.struct(F.col("Drug").alias("d"), T.number("AUC").alias("a"), T.number("IC50").alias("i")), "ord").alias("s"))
        m = m.join(last, "model_id", "left").select("model_id", "cell_line_name", "lineage", F.coalesce("s.d", F.lit(drug)).alias("drug"), F.col("s.a").alias("auc"), F.col("s.i").alias("ic50"))
    return m.select("*", F.lit("preclinical_cell_line").alias("response_domain"), F.concat(F.lit("depmap:"), "model_id").alias("source_id"))


def cell_line_bundle(payloads: DataFrame, drug: str | None = None, lineage: str = "breast|乳腺") -> DataFrame:
    """``cell_lines`` of saved bundles ``(ord, payload)`` with the lists ``models`` and ``sensitivity``.

    Fields go by either of their spellings; of equal models of one bundle each
    stays, the last sensitivity row of a model counts.
    """
    either = lambda doc, a, b: F.coalesce(F.when(F.trim(at(doc, a)) != "", at(doc, a)), at(doc, b))
    m = unnested(payloads, "payload", "models", "n", "x").select(either("x", "ModelID", "model_id").alias("ModelID"), either("x", "CellLineName", "cell_line_name").alias("CellLineName"), either("x", "OncotreeLineage", "lineage").alias("OncotreeLineage"))
    s = unnested(payloads, "payload", "sensitivity", "n", "x").select(either("x", "ModelID", "model_id").alias("ModelID"), either("x", "Drug", "drug").alias("Drug"), either("x", "AUC", "auc").alias("AUC"), either("x", "IC50", "ic50").alias("IC50"), F.struct("ord", "n").alias("ord"))
    return cell_lines(m, s, drug, lineage)


#: Accession numbers that a paper may name, the addresses of its record, and where its fields stand.
NAMED_DATA = r"\b(GSE\d+|NCT\d{8}|TCGA-[A-Z0-9-]+)\b"
RECORD_URL = "https://europepmc.org/article/"


def papers(payloads: DataFrame) -> DataFrame:
    """Papers of saved answers ``(ord, payload)`` of a literature search, in their order (``ord``, ``place``).

    Results without an id or a title are left out.  A full text is open where
    ``inEPMC`` says anything but no, or access is open.  A paper has its abstract,
    journal, year, authors, whether its full text is open, its record's
    address, and the distinct accession numbers of title and abstract.
    """
    own = lambda path: F.when(F.trim(at("x", path)) != "", F.trim(at("x", path)))
    r = unnested(payloads, "payload", "resultList.result", "place", "x")
    record, pmid = F.coalesce(own("id"), own("pmid")), own("pmid")
    kind = F.when(pmid.isNotNull(), "MED").otherwise(F.upper(F.coalesce(own("source"), F.lit("MED"))))
    people = F.transform(listed("x", "authorList.author"), lambda a: F.trim(F.coalesce(F.when(at(a, "fullName") != "", at(a, "fullName")), at(a, "lastName"), F.when(~a.startswith("{"), a), F.lit(""))))
    whole = F.concat_ws(" ", own("title"), own("abstractText"))
    out = r.select(
        "ord", "place", F.concat(F.lit("europepmc:"), record).alias("paper_id"), own("title").alias("title"), own("abstractText").alias("abstract"), pmid.alias("pmid"), own("doi").alias("doi"), own("journalTitle").alias("journal"),
        own("pubYear").try_cast("int").alias("publication_year"), F.filter(people, lambda p: p != "").alias("authors"), (F.coalesce(~at("x", "inEPMC").isin("", "false", "0"), F.lit(False)) | F.coalesce(at("x", "isOpenAccess") == "Y", F.lit(False))).alias("fulltext_available"),
        F.concat(F.lit(RECORD_URL), kind, F.lit("/"), F.call_function("url_encode", F.coalesce(pmid, record))).alias("source_url"), F.array_distinct(F.regexp_extract_all(F.upper(whole), F.lit(NAMED_DATA), F.lit(1))).alias("dataset_accessions"),
    )
    return out.filter("paper_id is not null and title is not null")


def molecular_profile(profiles: DataFrame, alteration: str, datatype: str | None = None, override: str | None = None) -> DataFrame:
    """The one profile of an alteration type: the one asked for, else that of the usual suffix, else the first by name."""
    x = profiles.filter(F.col("molecularAlterationType") == alteration)
    x = x.filter(F.col("datatype") == datatype) if datatype else x
    if override:
        return x.filter(F.col("molecularProfileId") == override).limit(1)
    usual = "_mutations" if alteration == "MUTATION_EXTENDED" else "_cna"
    return x.orderBy(F.when(F.col("molecularProfileId").endswith(usual), 0).otherwise(1), "molecularProfileId").limit(1)


def sample_list(lists: DataFrame, category: str, study: str, label: str, override: str | None = None) -> DataFrame:
    """The one sample list: the one asked for, else by category, by usual name, or of all cases; the least name of the first that fits."""
    if override:
        return lists.filter(F.col("sampleListId") == override).limit(1)
    usual = f"{study}_{'sequenced' if label == 'mutation' else 'cna'}"
    rank = F.when(F.col("category") == category, 0).when(F.col("sampleListId") == usual, 1).when(F.col("category") == "all_cases_in_study", 2)
    return lists.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", "sampleListId").limit(1).drop("_rank")


def directory_files(hrefs: DataFrame, kind: str = "supplement") -> DataFrame:
    """``(file_name, href)`` of a listing's usable files of a kind (``series_matrix``, ``soft`` or any), each name once, the last link of it.

    Links to other hosts, with queries, to parents or folders are left out.
    """
    h = F.url_decode(F.col("href"))
    name = F.element_at(F.split(h, "/"), -1)
    ok = ~F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|[?#]") & (h != "") & ~h.startswith("/") & ~h.endswith("/") & ~h.rlike(r"(^|/)(\.|\.\.|)(/|$)") & (F.lower(name) != "filelist.txt")
    ends = {"series_matrix": "series_matrix.txt.gz", "soft": ".soft.gz"}.get(kind)
    ok = ok & F.lower(name).endswith(ends) if ends else ok
    return hrefs.filter(ok).groupBy(name.alias("file_name")).agg(F.max_by("href", "ord").alias("href"))


def project_files(files: DataFrame, project: str, types: list[str], most: int, open_only: bool = True) -> DataFrame:
    """File metadata of a project: wanted types, open access if asked, the smallest first, at most ``most`` rows (a limit of the question)."""
    x = files.filter((F.col("project_id") == project) & F.col("data_type").isin(*types))
    x = x.filter("access = 'open'") if open_only else x
    return x.orderBy("file_size", "file_id").limit(most)


def catalogue_hits(records: DataFrame) -> DataFrame:
    """Catalogue records with a series accession: ``(accession, title, summary, n_samples)``, each accession once, the first of it."""
    up = F.upper(F.trim(T.text("accession")))
    x = records.filter(up.rlike("^GSE[0-9]+$")).select("ord", up.alias("accession"), "title", "summary", F.col("n_samples").cast("string").try_cast("int").alias("n_samples"))
    return first_of_each(x, "accession", ["ord"]).drop("ord")


def dataset_formats(records: DataFrame) -> DataFrame:
    """``(record_id, title, formats)``: sorted distinct suffixes of the file names of each record ``(record_id, title, files array)``."""
    suffix = F.array_sort(F.array_distinct(F.filter(F.transform("files", lambda f: F.lower(F.regexp_extract(f, r"\.([A-Za-z0-9]+)$", 1))), lambda s: s != "")))
    return records.select("record_id", "title", suffix.alias("formats"))


#: Words in the titles of sections of papers, by category, in the order in which they are tried.
CATEGORIES = [
    ("data_availability", "data availab|availability of data"), ("statistical_analysis", "statistic"), ("outcome_definition", "outcome|endpoint|end point"), ("cohort", "cohort|patients|population|participants"),
    ("methods", "method|material"), ("results", "result"), ("discussion", "discussion"), ("supplementary", "supplement"),
]


def section_category(title: Column | str) -> Column:
    x, out = F.lower(T.text(title)), None
    for name, words in CATEGORIES:
        out = F.when(x.rlike(words), name) if out is None else out.when(x.rlike(words), name)
    return out


def paper_categories(sections: DataFrame) -> DataFrame:
    """``(paper_id, category, text)``: texts of the sections ``(paper_id, ord, title, text)`` of a category, in order, put together."""
    x = sections.withColumn("category", section_category("title")).filter("category is not null")
    return x.groupBy("paper_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), " ").alias("text"))


def paper_accessions(sections: DataFrame, kind: str = "GSE") -> DataFrame:
    """``(paper_id, accessions)``: distinct accession numbers over all sections of a paper, in order of their first place."""
    x = sections.select("paper_id", "ord", F.posexplode(T.accessions("text", kind)).alias("n", "a")).groupBy("paper_id", "a").agg(F.min(F.struct("ord", "n")).alias("o"))
    return x.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "a"))), lambda s: s["a"]).alias("accessions"))


def first_paper(papers: DataFrame) -> DataFrame:
    """The first paper with an open full text: ``papers(ord, pmcid)``."""
    return papers.filter(F.upper(T.text("pmcid")).rlike("^PMC[0-9]+$")).orderBy("ord").limit(1)


def observations(rows: DataFrame, metadata: DataFrame | None, family: str, object_col: str = "SN", band: str = "band", error: str = "e_mag") -> DataFrame:
    """Catalogue rows as typed observations, with ``status`` ``accepted`` or ``rejected`` and the metadata of their object.

    A row needs finite ``MJD``, ``mag`` and ``error`` (not negative), a band
    and an object.  Metadata rows join by exact object name and must be
    unique by it; a repeated name is an error when it is read.
    """
    finite = lambda c: F.when(~F.lower(F.trim(T.text(c))).rlike("nan|inf"), T.number(c))
    x = rows.select("source_row", F.trim(T.text(object_col)).alias("object"), finite("MJD").alias("mjd"), F.trim(T.text(band)).alias("band"), finite("mag").alias("magnitude"), finite(error).alias("magnitude_error"))
    ok = F.col("mjd").isNotNull() & F.col("magnitude").isNotNull() & F.coalesce(F.col("magnitude_error") >= 0, F.lit(False)) & (F.col("band") != "") & (F.col("object") != "")
    if metadata is None:
        x = x.withColumns({"redshift_heliocentric": F.lit(None).cast("double"), "redshift_cmb": F.lit(None).cast("double"), "metadata_match": F.lit("unresolved")})
    else:
        one = metadata.groupBy(F.trim(T.text(object_col)).alias("object")).agg(F.count("*").alias("_n"), F.first(finite("z")).alias("redshift_heliocentric"), F.first(finite("zCMB")).alias("redshift_cmb"))
        one = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("metadata names an object twice")).cast("long")).otherwise(F.col("_n")))
        x = x.join(one, "object", "left").withColumn("metadata_match", F.when(F.col("_n").isNotNull(), "catalog_exact").otherwise("unresolved")).drop("_n")
    return x.select(F.concat(F.lit(f"{family}:"), F.col("source_row").cast("string")).alias("observation_id"), F.concat(F.lit(f"{family}:"), "object").alias("object_id"), "mjd", "band", "magnitude", "magnitude_error", "redshift_heliocentric", "redshift_cmb", "metadata_match", "source_row", F.when(ok, "accepted").otherwise("rejected").alias("status"))


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with the place of its first: what a keyed registry keeps."""
    w = Window.partitionBy(key)
    x = df.withColumns({"first_ord": F.min(order).over(w), "_last": F.max(order).over(w)})
    return x.filter(F.col(order) == F.col("_last")).drop("_last", order)


def merged_calls(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """Tool calls ``(ord, name, arguments)`` of both lists in order, equal ones once, at most ``most`` (a limit of the plan)."""
    both = first.select(F.lit(0).alias("g"), "ord", "name", "arguments").union(second.select(F.lit(1).alias("g"), "ord", "name", "arguments"))
    return both.groupBy("name", "arguments").agg(F.min(F.struct("g", "ord")).alias("o")).orderBy("o").limit(most).select("name", "arguments")


def keys_differ(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., side)`` of keys that only one side has; empty where the sets are equal."""
    a, b = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("unexpected")))
