"""The registered queries: each reads the star schema through the EDI pipeline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitframe.operators.features import FeatureEngineer, FeatureModel, label_dictionary
from remitframe.operators.quantile import exact_quantile
from remitframe.operators.scoring import RISK_BANDS, score_denials, train_denial_model
from remitframe.plans import reads
from remitframe.plans.dataset import build_dataset, dataset_stats
from remitframe.plans.ingest import ingest
from remitframe.session import checkpointed, delete_folder, drop_old_shuffles, shared_dir
from remitframe.sources.codes import load_code_masters
from remitframe.sources.files import Source, read_edi
from remitframe.sources.ranges import locate
from starcheck.starfeed import AS_OF, code_masters, star_source
from remitframe.sources.store import Store
from remitframe.streaming.incremental import stream_ingest

# Micro-batches that a large folder is streamed in; a small one has fewer, of 40 files.
STREAM_BATCHES = 12

_stores: dict[tuple[str, str], Store] = {}
_models: dict[tuple[str, str], FeatureModel] = {}
_folders: dict[tuple[str, str], str] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir.rstrip("/")


def render(spark: SparkSession, sf_dir: str) -> Source:
    """The tables as EDI text, laid out and checkpointed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return star_source(spark, sf_dir)


def build_store(spark: SparkSession, sf_dir: str, name: str,
                source: Source | None = None) -> Store:
    """Ingest the EDI text of all tables and return the store."""
    store = Store(spark, f"{shared_dir(spark)}/{name}")
    load_code_masters(store, code_masters(spark, sf_dir))
    # Text that is made here is nobody else's.
    ingest(source or render(spark, sf_dir), store, as_of_date=AS_OF, keep_text=False,
           delete_source=source is None)
    return store


def batch_store(spark: SparkSession, sf_dir: str, batches: int = 3) -> Store:
    """The same files in several batches, each numbered from 1 like any source."""
    key = (*_key(spark, sf_dir), "batches")
    if key not in _stores:
        digest = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        store, source = Store(spark, f"{shared_dir(spark)}/batches-{digest}"), render(spark, sf_dir)
        last = source.files.agg(F.max("upload_seq")).first()[0] or 0
        for n in range(batches):
            low, high = last * n // batches, last * (n + 1) // batches
            part = [d.where(F.col("upload_seq").between(low + 1, high)).withColumn(
                "upload_seq", F.col("upload_seq") - low) for d in (source.files, source.blocks)]
            ingest(Source(*part), store, as_of_date=AS_OF, keep_text=n == 0)
        delete_folder(spark, source.folder)
        _stores[key] = store
    return _stores[key]


def star_store(spark: SparkSession, sf_dir: str, source: Source | None = None) -> Store:
    """The ingested store for a data folder: built by the first query of a session."""
    key = _key(spark, sf_dir)
    if key not in _stores:
        digest = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        _stores[key] = build_store(spark, sf_dir, f"star-{digest}", source)
    return _stores[key]


def _as_real_file(blocks: DataFrame) -> DataFrame:
    """Text as senders write it: accents in payer names, and in each fourth file segments that end with
    a control character."""
    odd = F.replace("text", F.lit("N1*PR*"), F.lit("N1*PR*\u00c9"))
    return blocks.withColumn("text", F.when(F.col("upload_seq") % 4 == 1, F.replace(
        odd, F.lit("~"), F.lit("\x1d"))).when(F.col("upload_seq") % 2 == 1, odd).otherwise(
        F.col("text")))


def edi_folder(spark: SparkSession, sf_dir: str) -> str:
    """The same files as real ones, a folder each, with times in the order of their numbers.

    Each third submission is in Latin-1, the others are in UTF-8. Numbers that no file has go to files
    without any segment, so that all others keep theirs.
    """
    key = (*_key(spark, sf_dir), "folder")
    if key in _folders:
        return _folders[key]
    digest = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
    folder = f"{shared_dir(spark)}/edi-{digest}"

    def write(batches):
        number, out = None, None
        for batch in batches:
            numbers = []
            for seq, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq != number:
                    if out:
                        out.close()
                    store, place = locate(f"{folder}/upload_seq={seq}/part.edi")
                    store.create_dir(place.rpartition("/")[0])
                    number, out = seq, store.open_output_stream(place)
                    numbers.append(seq)
                # Blocks end with their last terminator, so a newline between two means nothing.
                out.write(f"{text}\n".encode("latin-1" if seq % 6 == 1 else "utf-8"))
            yield pa.RecordBatch.from_pydict({"upload_seq": pa.array(numbers, pa.int64())})
        if out:
            out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # A file is written by one task, so it holds one file's rows in order.
    source = render(spark, sf_dir)
    written = {r.upload_seq for r in _as_real_file(source.blocks).repartition(
        "upload_seq").sortWithinPartitions("upload_seq", "chunk", "block_seq").select(
        "upload_seq", "text").mapInArrow(write, "upload_seq long").collect()}
    delete_folder(spark, source.folder)
    drop_old_shuffles(spark)

    def dated(number: int) -> None:
        path = hadoop(f"{folder}/upload_seq={number}/"
                      + ("part.edi" if number in written else "none.txt"))
        if number not in written:   # a file that is none takes a number all the same
            out = files.create(path)
            out.write(b"none")
            out.close()
        files.setTimes(path, 1_700_000_000_000 + number * 1000, -1)
    # Many files, and each call waits for the store.
    with ThreadPoolExecutor(16) as pool:
        for _ in pool.map(dated, range(1, max(written, default=0) + 1)):
            pass
    _folders[key] = folder
    return folder


def file_store(spark: SparkSession, sf_dir: str) -> Store:
    """Ingest of real files in byte ranges of 64 KB, with their text kept."""
    key = (*_key(spark, sf_dir), "files")
    if key not in _stores:
        folder = edi_folder(spark, sf_dir)
        _stores[key] = Store(spark, f"{folder}-store")
        ingest(read_edi(spark, folder, range_bytes=1 << 16, block_bytes=1 << 14), _stores[key],
               as_of_date=AS_OF)
    return _stores[key]


def files_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archived text of each file, block after block, by length and digest of its segments."""
    return file_store(spark, sf_dir).read("raw_segments").groupBy("upload_seq").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.length("raw_segment_text")).alias("chars"),
        F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws(
            ":", "segment_position", "raw_segment_text")), 1, 15), 16, 10).cast("long")).alias(
            "digest"))


def stream_store(spark: SparkSession, sf_dir: str, files_per_batch: int = 40) -> Store:
    """The same files as a stream of micro-batches, each file in byte ranges."""
    key = (*_key(spark, sf_dir), "stream")
    if key not in _stores:
        folder = edi_folder(spark, sf_dir)
        query = stream_ingest(spark, folder, f"{folder}-streamed", f"{folder}-checkpoint",
                              as_of_date=AS_OF, files_per_batch=files_per_batch,
                              range_bytes=1 << 16, most_batches=STREAM_BATCHES)
        query.awaitTermination()
        _stores[key] = Store(spark, f"{folder}-streamed")
    return _stores[key]


def star_model(spark: SparkSession, sf_dir: str, dataset: DataFrame | None = None) -> FeatureModel:
    key = _key(spark, sf_dir)
    if key not in _models:
        _models[key] = FeatureEngineer().fit(
            build_dataset(star_store(spark, sf_dir)) if dataset is None else dataset)
    return _models[key]


def fitted_dataset(spark: SparkSession, sf_dir: str) -> tuple[FeatureModel, DataFrame]:
    """The model and the claims it is fitted on, which are joined from the store only once."""
    dataset = build_dataset(star_store(spark, sf_dir))
    if _key(spark, sf_dir) not in _models:
        dataset = checkpointed(dataset)
    return star_model(spark, sf_dir, dataset), dataset


def _no_raw(df: DataFrame) -> DataFrame:
    return df.drop("created_at", "updated_at", *[c for c in df.columns if c.startswith("raw_") and c.endswith("_segment")])


def segments_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = star_store(spark, sf_dir)
    # One small row per file; adaptive execution broadcasts it by measured size.
    types = store.read("edi_files").select("upload_seq", "file_type")
    per_file = store.read("raw_segments").groupBy("upload_seq", "segment_name").agg(
        F.count(F.lit(1)).alias("segments"), F.count("claim_id").alias("with_claim"),
        F.count("remittance_claim_id").alias("with_remittance"),
        F.sum("segment_position").alias("sum_position"))
    return per_file.join(types, "upload_seq").groupBy("file_type", "segment_name").agg(
        *[F.sum(c).alias(c) for c in ("segments", "with_claim", "with_remittance",
                                      "sum_position")])


def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = star_store(spark, sf_dir)
    claims = store.read("claims").select("claim_id", "is_placeholder",
                                         F.col("upload_seq").alias("claim_upload_seq"))
    return store.read("remittance_claims").select("remittance_claim_id", "claim_id").join(
        claims, "claim_id")


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_store(spark, sf_dir).read("claims").where("is_placeholder").select(
        "claim_id", "claim_number", "total_charge_amount", "service_from_date", "upload_seq")


def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = star_store(spark, sf_dir)
    failed = store.read("ingest_summary").where("not success").select("upload_seq", "file_name")
    return failed.join(store.read("ingest_errors").select("upload_seq", "error"), "upload_seq")


def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.current_claims(star_store(spark, sf_dir)).groupBy(
        "claim_status", "is_placeholder").agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum("total_charge_amount").cast("decimal(18,2)").alias("charged"))


def claim_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail of the first denied claim, with its nested children summed up."""
    store = star_store(spark, sf_dir)
    wanted = reads.find_claims(store, claim_status="denied").where("not is_placeholder").agg(
        F.min("claim_id")).first()[0]
    detail = reads.claim_detail(store, -1 if wanted is None else wanted)
    remits = F.col("remittance_claims")

    def total(name):
        return F.aggregate(remits, F.lit(0), lambda n, r: n + F.size(r[name])).cast("long")
    return detail.select(
        "claim_id", "claim_number", "claim_status",
        F.size("claim_lines").cast("long").alias("lines"),
        F.size("diagnoses").cast("long").alias("diagnoses"),
        F.size(remits).cast("long").alias("remittances"),
        total("adjustments").alias("adjustments"), total("remark_codes").alias("remarks"),
        F.get("claim_lines", F.lit(0))["procedure_code"].alias("first_procedure"),
        F.get(F.flatten(F.transform(remits, lambda r: r["adjustments"])), F.lit(0))[
            "adjustment_amount"].alias("first_adjustment"))


def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = star_store(spark, sf_dir)
    per_code = store.read("claim_lines").groupBy("place_of_service").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("billed_amount").cast("decimal(18,2)").alias("billed"))
    return reads.with_code_descriptions(per_code, store.read("code_masters"), "pos",
                                        "place_of_service")


def described_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in use of the other three code types, with their descriptions."""
    store = star_store(spark, sf_dir)
    codes, out = store.read("code_masters"), None
    for kind, table, column in (("carc", "adjustments", "adjustment_reason_code"),
                                ("rarc", "remark_codes", "remark_code"),
                                ("claim_status", "remittance_claims", "claim_status_code")):
        counted = store.read(table).groupBy(F.col(column).alias("code")).agg(
            F.count(F.lit(1)).alias("uses"))
        part = reads.with_code_descriptions(counted, codes, kind, "code").select(
            F.lit(kind).alias("code_type"), "code", "description", "uses")
        out = part if out is None else out.unionByName(part)
    return out


def updated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a later batch changed a claim."""
    return reads.current_claims(batch_store(spark, sf_dir)).select(
        "claim_id", (F.col("updated_at") > F.col("created_at")).alias("changed"))


def _first_found(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Claims that share a key with the first claim that has one."""
    store = star_store(spark, sf_dir)
    first = store.read("claims").where(F.col(column).isNotNull()).agg(
        F.min_by(column, "claim_id")).first()[0]
    return reads.find_claims(store, **{column: first}).select(
        "claim_id", "claim_number", "claim_status", column if column != "claim_number"
        else "total_charge_amount")


def denials_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = star_store(spark, sf_dir)
    wanted = reads.find_claims(store, claim_status="denied").agg(F.min("claim_id")).first()[0]
    return reads.denials(store, -1 if wanted is None else wanted)


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the one ``list_claims`` stops at, by key instead of by offset."""
    store = star_store(spark, sf_dir)
    last = reads.list_claims(store, 999, 1).first()
    if last is None:
        return _no_raw(reads.list_claims(store, 1000, 100))
    return _no_raw(reads.list_claims(store, 0, 100, before=(last.created_at, last.claim_id)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, dataset = fitted_dataset(spark, sf_dir)
    return model.transform(dataset, keep=("claim_id",))


def features_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features from a model that was saved and loaded."""
    path = f"{shared_dir(spark)}/saved-model"
    model, dataset = fitted_dataset(spark, sf_dir)
    model.save(path)
    return FeatureModel.load(spark, path).transform(dataset, keep=("claim_id",))


def charge_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = build_dataset(star_store(spark, sf_dir))
    value = exact_quantile(dataset, "total_charge_amount", 0.75)
    return dataset.groupBy().agg(F.lit(value).cast("decimal(18,4)").alias("threshold"))


def denial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every adjudicated claim scored by a model trained on those claims, and whether score and
    level are as they have to be."""
    model, dataset = fitted_dataset(spark, sf_dir)
    # Computed once: training alone reads its rows several times.
    features = checkpointed(model.transform(dataset, validate=False, keep=("claim_id", "denied")))
    scored = score_denials(features, train_denial_model(features))
    p, level = F.col("denial_probability"), F.lit(None).cast("string")
    for low, name in RISK_BANDS:
        level = F.when(p >= low, name).otherwise(level)
    return scored.select("claim_id", "denied", p.between(0, 1).alias("in_range"),
                         (F.col("risk_level") == level).alias("in_band"))


def _read(table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _no_raw(star_store(spark, sf_dir).read(table))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "segments_archive": segments_archive,
        "edi_files": _read("edi_files"),
        "ingest_summary": _read("ingest_summary"),
        "claims": lambda s, d: _no_raw(reads.current_claims(star_store(s, d))),
        "claim_lines": _read("claim_lines"),
        "diagnoses": _read("diagnoses"),
        "parse_errors": _read("ingest_errors"),
        "remittances": _read("remittance_claims"),
        "adjustments": _read("adjustments"),
        "remarks": _read("remark_codes"),
        "resolution": resolution,
        "placeholders": placeholders,
        "rejected_files": rejected_files,
        "claim_status": claim_status,
        "list_claims": lambda s, d: _no_raw(reads.list_claims(star_store(s, d), 1000, 100)),
        "list_edi_files": lambda s, d: reads.list_edi_files(star_store(s, d), 5, 20).select(
            "upload_seq", "file_type", "interchange_control_no"),
        "claim_detail": claim_detail,
        "claim_tree": lambda s, d: reads.claim_tree(star_store(s, d)),
        "denials": lambda s, d: reads.denials(star_store(s, d)),
        "code_lookup": code_lookup,
        "find_claims": lambda s, d: reads.find_claims(
            star_store(s, d), claim_status="void").select(
            "claim_id", "claim_number", "total_charge_amount"),
        "find_adjustments": lambda s, d: reads.find_adjustments(star_store(s, d), "45").select(
            "remittance_claim_id", "segment_position", "adjustment_amount"),
        "dataset": lambda s, d: build_dataset(star_store(s, d)),
        "dataset_stats": lambda s, d: dataset_stats(build_dataset(star_store(s, d))).withColumn(
            "denial_rate", F.round("denial_rate", 6)),
        "label_dictionary": lambda s, d: label_dictionary(build_dataset(star_store(s, d))),
        "charge_threshold": charge_threshold,
        "features": features,
        "feature_unseen": lambda s, d: star_model(s, d).transform(
            build_dataset(star_store(s, d), adjudicated_only=False), keep=("claim_id",)),
        "features_saved": features_saved,
        "features_at_once": lambda s, d: FeatureEngineer().fit_transform(
            build_dataset(star_store(s, d))),
        "denial_scores": denial_scores,
        "described_codes": described_codes,
        "ingest_in_batches": lambda s, d: _no_raw(reads.current_claims(batch_store(s, d))),
        "remittances_in_batches": lambda s, d: _no_raw(
            batch_store(s, d).read("remittance_claims")),
        "updated_claims": updated_claims,
        "files_text": files_text,
        "files_claims": lambda s, d: _no_raw(reads.current_claims(file_store(s, d))),
        "stream_claims": lambda s, d: _no_raw(reads.current_claims(stream_store(s, d))),
        "find_claims_by_number": lambda s, d: _first_found(s, d, "claim_number"),
        "find_claims_by_member": lambda s, d: _first_found(s, d, "patient_member_id"),
        "find_claims_by_file": lambda s, d: _first_found(s, d, "upload_seq"),
        "denials_by_id": denials_by_id,
        "next_page": next_page,
    }
