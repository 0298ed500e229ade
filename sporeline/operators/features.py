"""Genome features: GFF3 rows, gene models, markers. Coordinates are 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.bases import peptide
from sporeline.functions.numbering import numbered
from sporeline.functions.storage import materialize
from sporeline.operators import chunks as C


def marker_conflicts(genome: DataFrame, maps: DataFrame) -> DataFrame:
    """(marker, locations) of markers on more than one chromosome; inputs have marker, chr, and maps a map name."""
    rows = genome.select("marker", F.lit("genome").alias("map"), "chr").unionByName(maps.select("marker", "map", "chr")).distinct()
    per = rows.groupBy("marker").agg(F.countDistinct("chr").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat("map", F.lit(":"), "chr"))), ",").alias("locations"))
    return per.where("n > 1").select("marker", "locations")


def marker_midpoints(features: DataFrame, locations: DataFrame) -> DataFrame:
    """(marker, chr, position, span_check) where feature and map agree on the chromosome; position is the middle, half to even, in megabases."""
    j = features.join(locations, ["marker", "chr"])
    span = F.col("end") - F.col("start")
    check = F.when(span > 200, "error").when(span < 100, "warn").otherwise("ok")
    return j.select("marker", "chr", (F.bround((F.col("start") + F.col("end")) / 2, 0) / 1e6).alias("position"), check.alias("span_check"))


def flip_linkage_group(locations: DataFrame) -> DataFrame:
    """Positions counted from the other end of each map's linkage group; so are ``north`` and ``south``, null where null or 0."""
    top = F.max("position").over(Window.partitionBy("map", "linkage_group"))
    ends = {c: F.when(F.col(c) != 0, top - F.col(c)) for c in ("north", "south") if c in locations.columns}
    return locations.withColumns(ends | {"position": top - F.col("position")})


def normalize_features(features: DataFrame, source: str | None = None, types: dict[str, str] | None = None, prefix: str = "") -> DataFrame:
    """One source, renamed types, ends in order, library prefix on names without it, distinct aliases, and the target put right.

    A target that begins with 'x' names the first alias, else the first name;
    its ends are put in order and a missing strand is '+'.
    """
    kind = F.col("type")
    for old, new in (types or {}).items():
        kind = F.when(F.col("type") == old, new).otherwise(kind)
    attrs = F.transform_values(
        "attrs",
        lambda k, v: F.when(k == "Alias", F.array_distinct(v)).when(k == "Name", F.transform(v, lambda x: F.when(x.startswith(prefix), x).otherwise(F.concat(F.lit(prefix), x)))).otherwise(v),
    )
    out = features.withColumns({"source": F.lit(source) if source else F.col("source"), "type": kind, "start": F.least("start", "end"), "end": F.greatest("start", "end"), "attrs": attrs})
    called = F.coalesce(F.get(F.try_element_at("attrs", F.lit("Alias")), F.lit(0)), F.get(F.try_element_at("attrs", F.lit("Name")), F.lit(0)))
    words = F.split(F.element_at(F.try_element_at("attrs", F.lit("Target")), 1), r"\s+")
    named = F.when((words[0] == "x") & called.isNotNull(), called).otherwise(words[0])
    a, b = words[1].cast("long"), words[2].cast("long")
    fixed = F.concat_ws(" ", named, F.least(a, b).cast("string"), F.greatest(a, b).cast("string"), F.coalesce(F.get(words, F.lit(3)), F.lit("+")))
    return out.withColumn("attrs", F.transform_values("attrs", lambda k, v: F.when(k == "Target", F.array(fixed)).otherwise(v)))


def unique_ids(features: DataFrame) -> DataFrame:
    """Rows sorted by (seqid, start); repeated IDs, less a number they end in, become id_2, id_3, ... in line order; Parents follow the latest ID line above them.

    A row without an ID gets seqid_type_n, n counting such rows of its type:
    only these are numbered, over the whole table, less the number where their type begins.
    """
    own = F.get(F.try_element_at("attrs", F.lit("ID")), F.lit(0))
    lone = numbered(features.where(own.isNull()).select("type", "line_no"), [F.col("type"), F.col("line_no")], "_n")
    begins = lone.groupBy(F.col("type").alias("_type")).agg(F.min("_n").alias("_first"))  # one row a type
    lone = lone.join(F.broadcast(begins), F.col("type").eqNullSafe(F.col("_type"))).select("line_no", (F.col("_n") - F.col("_first") + 1).alias("_lone"))
    rows = features.join(lone, "line_no", "left").select(*features.columns, "_lone")
    rows = rows.withColumns({"_own": own, "_made": F.when(own.isNull(), F.concat_ws("_", "seqid", "type", F.col("_lone").cast("string")))})
    rows = rows.withColumns({"_old": F.coalesce("_own", "_made"), "_root": F.coalesce(F.regexp_replace("_own", r"_\d+$", ""), "_made")})
    n = F.row_number().over(Window.partitionBy("_root").orderBy("line_no"))
    rows = rows.withColumn("_new", F.when(n == 1, F.col("_root")).otherwise(F.concat_ws("_", "_root", n.cast("string"))))
    parents = rows.select("line_no", "seqid", "source", F.explode(F.coalesce(F.try_element_at("attrs", F.lit("Parent")), F.array().cast("array<string>"))).alias("_p"))
    ids = rows.select("line_no", "seqid", "source", F.col("_old").alias("_p"), "_new")
    both = ids.unionByName(parents.withColumn("_new", F.lit(None).cast("string")))
    latest = F.last("_new", ignorenulls=True).over(Window.partitionBy("seqid", "source", "_p").orderBy("line_no"))
    mapped = both.withColumn("_to", latest).where("_new IS NULL").groupBy("line_no").agg(F.array_sort(F.collect_list(F.coalesce("_to", "_p"))).alias("_parents"))
    rows = rows.join(mapped, "line_no", "left")
    attrs = F.map_concat(F.map_filter("attrs", lambda k, v: ~k.isin("ID", "Parent")), F.create_map(F.lit("ID"), F.array("_new")))
    attrs = F.when(F.col("_parents").isNotNull(), F.map_concat(attrs, F.create_map(F.lit("Parent"), F.col("_parents")))).otherwise(attrs)
    return rows.withColumn("attrs", attrs).select(*features.columns).orderBy("seqid", "start")


def edit_attributes(features: DataFrame, edits: list[tuple[str, str, str]]) -> DataFrame:
    """Values of attributes whose name matches changed by (name pattern, pattern, replacement), one edit after the other."""

    def changed(k: Column, v: Column) -> Column:
        for name, pattern, new in edits:
            v = F.when(k.rlike(name), replaced(v, pattern, new)).otherwise(v)
        return v

    def replaced(v: Column, pattern: str, new: str) -> Column:
        return F.transform(v, lambda x: F.regexp_replace(x, pattern, new))

    return features.withColumn("attrs", F.transform_values("attrs", changed))


def sequence_regions(declared: DataFrame, seqs: DataFrame) -> DataFrame:
    """(seqid, start, end, conflicts): one region a sequence: its whole length where ``seqs`` (id, length) knows it, else the first one declared.

    ``declared`` has seqid, start, end, line_no; ``conflicts`` counts declared
    lines that differ from the region.
    """
    known = seqs.select(F.col("id").alias("seqid"), F.struct(F.lit(1).cast("long").alias("start"), F.col("length").cast("long").alias("end")).alias("k"))
    per = declared.groupBy("seqid").agg(F.min_by(F.struct("start", "end"), "line_no").alias("d"))
    chosen = per.join(known, "seqid", "full").select("seqid", F.coalesce("k", "d").alias("r"))
    differ = declared.join(chosen, "seqid").where((F.col("start") != F.col("r.start")) | (F.col("end") != F.col("r.end"))).groupBy("seqid").agg(F.count("*").alias("n"))
    return chosen.join(differ, "seqid", "left").select("seqid", "r.start", "r.end", F.coalesce("n", F.lit(0)).alias("conflicts"))


def mark_partial(features: DataFrame, five: DataFrame, three: DataFrame) -> DataFrame:
    """Genes and mRNAs whose id is in either list get 5' and / or 3' added to their ``partial`` attribute."""
    gene = F.regexp_replace(F.element_at("attrs", "ID")[0], r"^(gene:|mRNA:)|(\.\d+)$", "")
    rows = features.withColumn("_id", gene)
    for name, ids in (("_5", five), ("_3", three)):
        rows = rows.join(ids.select(F.col("id").alias("_id"), F.lit(name[1] + "'").alias(name)).distinct(), "_id", "left")
    ends = F.array_compact(F.array("_5", "_3"))
    marked = F.when(F.col("type").isin("gene", "mRNA") & (F.size(ends) > 0), F.map_concat(F.map_filter("attrs", lambda k, v: k != "partial"), F.create_map(F.lit("partial"), F.concat(F.coalesce(F.try_element_at("attrs", F.lit("partial")), F.array().cast("array<string>")), ends))))
    return rows.withColumn("attrs", F.coalesce(marked, "attrs")).select(*features.columns)


def add_functions(genes: DataFrame, specific: DataFrame, general: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, go_terms, go_source, note): specific terms else general ones; a gene without a note fails the job."""
    listed = lambda df, name: df.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("go_id")), ",").alias(name))
    j = genes.select("id").join(listed(specific, "_s"), "id", "left").join(listed(general, "_g"), "id", "left").join(notes.groupBy("id").agg(F.min("note").alias("note")), "id", "left")
    note = F.when(F.col("note").isNotNull(), F.col("note")).otherwise(F.raise_error(F.concat(F.lit("no note for "), "id")))
    return j.select("id", F.coalesce("_s", "_g").alias("go_terms"), F.when(F.col("_s").isNotNull(), "specific").when(F.col("_g").isNotNull(), "general").alias("go_source"), note.alias("note"))


def spliced_sequences(features: DataFrame, seqs: DataFrame, kind: str = "CDS") -> DataFrame:
    """(parent, seq, regions): pieces of each mRNA cut, put together in order, reverse-complemented on the minus strand. Ids of sequences are unique."""
    return C.spliced(features, C.chunked(seqs), kind)


def spliced_proteins(features: DataFrame, seqs: DataFrame) -> DataFrame:
    """(parent, protein, regions): the coding pieces of each mRNA put together and translated, without the last stop."""
    whole = spliced_sequences(features, seqs, "CDS")
    return whole.select("parent", F.regexp_replace(peptide(F.upper("seq")), r"\*$", "").alias("protein"), "regions")


def recalc_utrs(features: DataFrame) -> DataFrame:
    """(parent, type, start, end): UTR pieces = exons minus the span of the CDS, named by strand."""
    span = features.where("type = 'CDS'").groupBy("parent").agg(F.min("start").alias("cs"), F.max("end").alias("ce"))
    exons = features.where("type = 'exon'").join(span, "parent")
    left = F.struct(F.col("start").alias("start"), F.least(F.col("end"), F.col("cs") - 1).alias("end"), F.lit("left").alias("side"))
    right = F.struct(F.greatest(F.col("start"), F.col("ce") + 1).alias("start"), F.col("end").alias("end"), F.lit("right").alias("side"))
    parts = exons.select("parent", "strand", F.explode(F.array(left, right)).alias("u")).where("u.start <= u.end")
    five = (F.col("u.side") == "left") == (F.col("strand") != "-")
    return parts.select("parent", F.when(five, "five_prime_UTR").otherwise("three_prime_UTR").alias("type"), F.col("u.start").alias("start"), F.col("u.end").alias("end"))


#: Rows that one task sorts.
ROWS = 100_000


def _tasks(rows: DataFrame) -> int:
    """Partitions for ``rows``: they grow in number with the table, and not in size."""
    return rows.count() // ROWS + 1


def fused_exons(features: DataFrame) -> DataFrame:
    """(parent, strand, start, end): exons of each parent, those with a coding piece in the gap between them as one.

    A gap is closed when a CDS holds the place after an exon or before the next.
    """
    exons = features.where("type = 'exon'").select("parent", "strand", "start", "end").distinct()
    by = Window.partitionBy("parent").orderBy("start", "end")
    gaps = exons.withColumn("_next", F.lead("start").over(by))  # in the partitions of the parents, as all that follows
    cds = features.where("type = 'CDS'").select("parent", F.col("start").alias("cs"), F.col("end").alias("ce"))
    over = F.col("_next").isNotNull() & (((F.col("cs") <= F.col("end") + 1) & (F.col("ce") >= F.col("end") + 1)) | ((F.col("cs") <= F.col("_next") - 1) & (F.col("ce") >= F.col("_next") - 1)))
    marked = gaps.join(cds, "parent", "left").groupBy("parent", "strand", "start", "end").agg(F.max(F.coalesce(over, F.lit(False))).alias("_closed"))
    marked = marked.withColumn("_closed", F.max("_closed").over(Window.partitionBy("parent", "start", "end")))
    marked = marked.withColumn("_new", F.when(F.lag("_closed").over(by), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy("parent", "strand", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def next_version(name: Column) -> Column:
    """The first '.number' of an id raised by one; ids without one stay."""
    part = lambda i: F.regexp_extract(name, r"^(.*?)\.(\d+)(.*)$", i)
    return F.when(part(2) != "", F.concat(part(1), F.lit("."), (part(2).cast("long") + 1).cast("string"), part(3))).otherwise(name)


def rebuild_models(features: DataFrame) -> DataFrame:
    """(parent, type, start, end): each parent's coding pieces, fused exons and new UTRs under its next version; introns and old UTRs are left out."""
    features = features.repartition(_tasks(features), "parent")
    exons = fused_exons(features)
    cds = features.where("type = 'CDS'").select("parent", "strand", "start", "end")
    parts = exons.withColumn("type", F.lit("exon")).unionByName(cds.withColumn("type", F.lit("CDS")))
    rows = parts.select("parent", "type", "start", "end").unionByName(recalc_utrs(parts))
    return rows.select(next_version(F.col("parent")).alias("parent"), "type", "start", "end")


def trim_models(features: DataFrame, trims: DataFrame) -> DataFrame:
    """Genes shrunk by (gene, five, three), five rounded up to a codon; children clamped, those of no more than one base dropped. Genes without a trim stay as they are."""
    genes = features.where("type = 'gene'").join(trims, "gene", "left")
    five = F.ceil(F.coalesce("five", F.lit(0)) / 3) * 3
    three = F.coalesce("three", F.lit(0))
    minus = F.col("strand") == "-"
    spans = genes.select("gene", (F.col("start") + F.when(minus, three).otherwise(five)).alias("_s"), (F.col("end") - F.when(minus, five).otherwise(three)).alias("_e"), ((five > 0) | (three > 0)).alias("_cut"))
    clamped = {"start": F.when(F.col("_cut"), F.greatest("start", "_s")).otherwise(F.col("start")), "end": F.when(F.col("_cut"), F.least("end", "_e")).otherwise(F.col("end"))}
    return features.join(spans, "gene").withColumns(clamped).where("NOT _cut OR start < end").select(*features.columns)


def move_features(features: DataFrame, moves: DataFrame) -> DataFrame:
    """Features shifted by the edits of their sequence in order: (seqid, ord, loc, shift), as Q13 applies them.

    An insert before a feature's first base or further up shifts it, one inside
    makes it longer and invalid. A deletion whose last base is not beyond the
    feature's first shifts it, one that reaches it otherwise makes it invalid.
    """
    listed = moves.groupBy("seqid").agg(F.array_sort(F.collect_list(F.struct("ord", "loc", "shift"))).alias("_m"))
    zero = F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.lit(True).alias("ok"))

    def step(acc: Column, m: Column) -> Column:
        grows = m["shift"] > 0
        up = F.when(grows, m["loc"] <= acc["s"]).otherwise(m["loc"] - 1 <= acc["s"])
        below = F.when(grows, m["loc"] > acc["e"]).otherwise(m["loc"] + m["shift"] > acc["e"])
        s = F.when(up, acc["s"] + m["shift"]).otherwise(acc["s"])
        e = F.when(up | (grows & ~below), acc["e"] + m["shift"]).otherwise(acc["e"])
        return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), (acc["ok"] & (up | below | (m["shift"] == 0))).alias("ok"))

    empty = F.array().cast("array<struct<ord:bigint,loc:bigint,shift:bigint>>")
    listed = listed.withColumn("_m", F.col("_m").cast("array<struct<ord:bigint,loc:bigint,shift:bigint>>"))
    j = features.join(listed, "seqid", "left").withColumn("_t", F.aggregate(F.coalesce("_m", empty), zero, step))
    return j.withColumns({"start": F.col("_t.s"), "end": F.col("_t.e"), "valid": F.col("_t.ok")}).select(*features.columns, "valid")


def invalid_families(moved: DataFrame) -> DataFrame:
    """Ids (id) of moved features (id, parent, valid; a row a parent) that an edit cut, of all above them and of all below those."""
    links = materialize(moved.where("parent IS NOT NULL").select("id", "parent").distinct())
    cut = materialize(moved.where("NOT valid").select("id").distinct())
    above = _reached(cut, links, "id", "parent")
    return _reached(above, links, "parent", "id")


def _reached(start: DataFrame, links: DataFrame, near: str, far: str) -> DataFrame:
    """(id): ``start`` and all that links lead to, however far: each round follows what the last one found, until nothing is new."""
    found, front = start, start
    while True:
        step = links.join(front.select(F.col("id").alias(near)), near, "left_semi").select(F.col(far).alias("id")).distinct()
        new = materialize(step.join(found, "id", "left_anti"))
        if new.isEmpty():
            return found
        found, front = materialize(found.unionByName(new)), new


def region_lengths(regions: DataFrame, moves: DataFrame) -> DataFrame:
    """(seqid, length) of sequence regions after the moves that start within them."""
    j = regions.join(moves.select("seqid", "loc", "shift"), "seqid", "left")
    return j.groupBy("seqid", "length").agg(F.coalesce(F.sum(F.when(F.col("loc") <= F.col("length"), F.col("shift"))), F.lit(0)).alias("_by")).select("seqid", (F.col("length") + F.col("_by")).alias("length"))


def merge_gene_builds(new: DataFrame, old: DataFrame) -> DataFrame:
    """I16: (id, locus, type, start, end, source, attrs, version, place): new models over old ones by id.

    Attributes are merged, new wins on ID, Parent, Name. Where a span changed,
    the version of every row of its locus goes up by one. ``place`` is 0 for
    genes and mRNAs, which come first, else 1.
    """
    o = old.select("id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("attrs").alias("_a"), F.col("version").alias("_v"))
    j = new.join(o, "id", "left")
    merged = F.map_zip_with("attrs", F.coalesce("_a", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))), lambda k, x, y: F.when(k.isin("ID", "Parent", "Name"), F.coalesce(x, y)).otherwise(F.array_distinct(F.concat(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))))))
    changed = F.col("_s").isNotNull() & ((F.col("start") != F.col("_s")) | (F.col("end") != F.col("_e")))
    own = ["id", "locus", "type", "start", "end", "source"]
    raised = j.where(changed).select("locus").distinct().withColumn("_up", F.lit(1))
    mine = j.select(*own, merged.alias("attrs"), F.coalesce("_v", F.lit(1)).cast("long").alias("version"))
    kept = old.join(new.select("id"), "id", "left_anti").select(*own, "attrs", F.col("version").cast("long").alias("version"))
    rows = mine.unionByName(kept).join(raised, "locus", "left")
    place = F.when(F.col("type").isin("gene", "mRNA"), 0).otherwise(1)
    return rows.select(*own, "attrs", (F.col("version") + F.coalesce("_up", F.lit(0))).alias("version"), place.alias("place"))


def _product(note: Column) -> Column:
    """A description as a product name: without its evidence part, cleaned word by word."""
    bare = F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"(?s)\(AHRD.+", ""))
    bare = F.when((bare == "") | bare.endswith("-"), "hypothetical protein").otherwise(bare)
    pieces = F.regexp_extract_all(bare, F.lit(r"(\w+|\W+)"), F.lit(1))

    def clean(w: Column) -> Column:
        low = F.when(w.rlike("[A-Z][a-z]{2,}"), F.lower(w)).otherwise(w)
        return F.when(low == "unknown", "hypothetical").when(low.isin("probable", "possible", "predicted", "potential"), "putative").otherwise(low)

    return F.array_join(F.transform(pieces, clean), "")


_EC = r"\(\s*EC\s*(\d[^\s)]+)\s*\)"
_AGI = r"\(?(At[\dMC]g\d+)\)?"


def transcript_qualifiers(mrnas: DataFrame, go: DataFrame, prefix: str) -> DataFrame:
    """(mrna, kind, q, key, value): qualifiers of the mRNA and of the CDS of each transcript, in order.

    ``mrnas`` has mrna, name, note, terms; ``go`` has go_id, name, namespace.
    """
    names = mrnas.select("mrna", F.explode(F.coalesce("terms", F.array().cast("array<string>"))).alias("go_id")).join(go.withColumnRenamed("name", "term"), "go_id")
    key = F.when(F.col("namespace") == "biological_process", "go_process").when(F.col("namespace") == "molecular_function", "go_function").otherwise("go_component")
    value = F.concat_ws("|", F.regexp_replace("term", r"\(obsolete.*", ""), F.regexp_extract("go_id", r"(\d+)", 1), F.lit(""), F.lit("ISS"))
    named = names.groupBy("mrna").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value")))).alias("_go"))
    one = lambda k, v: F.array(F.struct(F.lit(k).alias("key"), v.alias("value")))
    many = lambda k, a, f=lambda x: x: F.transform(a, lambda x: F.struct(F.lit(k).alias("key"), f(x).alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    rows = mrnas.join(named, "mrna", "left").withColumn("_p", _product(F.col("note")))
    note = F.coalesce("note", F.lit(""))
    tag = F.regexp_replace("name", r"^([^.]*)\.\d+", "$1.x")
    agi = F.regexp_extract_all("_p", F.lit(_AGI), F.lit(1))
    ec = F.regexp_extract_all("_p", F.lit(_EC), F.lit(1))
    product = F.trim(F.regexp_replace(F.regexp_replace("_p", _AGI, ""), r"\s*" + _EC, ""))
    ipr = F.regexp_extract_all(note, F.lit(r"\b(IPR\d+)\b"), F.lit(1))
    alike = F.regexp_extract(note, r"\(AHRD\s+V\d+\s+[-*]+\s+([^\s)]+)\)", 1)
    other = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda x: ~x.startswith("GO:"))
    shared = F.concat(
        one("protein_id", F.concat(F.lit(prefix), tag)), one("transcript_id", F.concat(F.lit(prefix + "mRNA:"), tag)),
        F.when(F.col("note").isNotNull(), F.concat(many("note", agi, lambda x: F.concat(F.lit("similar to "), x)), one("product", product), many("db_xref", ipr, lambda x: F.concat(F.lit("InterPro:"), x)), many("inference", ipr, lambda x: F.concat(F.lit("protein motif:InterPro:"), x)))).otherwise(none),
        F.when(alike != "", one("note", F.concat(F.lit("similar to "), alike))).otherwise(none), F.coalesce("_go", none), many("db_xref", other),
    )
    kinds = F.array(F.struct(F.lit("mRNA").alias("kind"), shared.alias("a")), F.struct(F.lit("CDS").alias("kind"), F.concat(shared, many("EC_number", ec)).alias("a")))
    each = rows.select("mrna", F.explode(kinds).alias("k")).select("mrna", "k.kind", F.posexplode("k.a").alias("q", "x"))
    return each.select("mrna", "kind", "q", "x.key", "x.value")


def feature_table(genes: DataFrame, mrnas: DataFrame, parts: DataFrame, go: DataFrame, prefix: str = "gnl|WGS:X|") -> DataFrame:
    """(seqid, gene, ord, value): the lines of an NCBI feature table, ordered by gene, transcript and place.

    ``genes`` has seqid, gene, strand, start, end; ``mrnas`` gene, mrna, name,
    strand, note, partial, terms; ``parts`` mrna, type (exon or CDS), start,
    end. Pieces run along the strand, by start, then end; '<' and '>' mark partial coding ends.
    """
    minus = F.col("strand") == "-"
    first, last = F.when(minus, F.col("end")).otherwise(F.col("start")), F.when(minus, F.col("start")).otherwise(F.col("end"))
    parts = materialize(parts)
    tasks = _tasks(parts)
    places = mrnas.join(genes.select("gene", "seqid"), "gene")
    head = genes.select("seqid", "gene", F.struct(F.lit("").alias("mrna"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("i")).alias("ord"), F.concat_ws("\t", first.cast("string"), last.cast("string"), F.lit("gene")).alias("value"))
    j = places.select("seqid", "gene", "mrna", "strand", "partial").repartition(tasks, "mrna").join(parts.repartition(tasks, "mrna"), "mrna")
    n = F.row_number().over(Window.partitionBy("mrna", "type").orderBy(F.when(minus, -F.col("start")).otherwise(F.col("start")), F.when(minus, -F.col("end")).otherwise(F.col("end")))) - 1
    total = F.count("*").over(Window.partitionBy("mrna", "type"))
    j = j.withColumns({"_n": n.cast("long"), "_all": total})
    cds = F.col("type") == "CDS"
    open5 = cds & (F.col("_n") == 0) & F.coalesce(F.array_contains("partial", "5'"), F.lit(False))
    open3 = cds & (F.col("_n") == F.col("_all") - 1) & F.coalesce(F.array_contains("partial", "3'"), F.lit(False))
    mark = lambda test, sign: F.when(test, sign).otherwise("")
    name = F.when(F.col("_n") == 0, F.when(cds, "CDS").otherwise("mRNA"))
    line = F.concat_ws("\t", F.concat(mark(open5, "<"), first.cast("string")), F.concat(mark(open3, ">"), last.cast("string")), name)
    pieces = j.select("seqid", "gene", F.struct("mrna", F.when(cds, 3).otherwise(1).alias("k"), F.col("_n").alias("i")).alias("ord"), line.alias("value"))
    quals = transcript_qualifiers(mrnas, go, prefix).join(places.select("mrna", "gene", "seqid"), "mrna")
    quals = quals.select("seqid", "gene", F.struct("mrna", F.when(F.col("kind") == "CDS", 4).otherwise(2).alias("k"), F.col("q").cast("long").alias("i")).alias("ord"), F.concat_ws("\t", F.lit("\t\t"), "key", "value").alias("value"))
    return head.unionByName(pieces).unionByName(quals)
