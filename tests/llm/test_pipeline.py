"""The pipeline stage by stage and in turn: which rows stages keep, edit or repeat, on the small, odd and empty tables."""

import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_contracts import CASES, documents, folders  # noqa: F401
from test_ngram_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from playgauge.llm import mixing, pii, queries, toxicity


def bag(rows):
    return Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows)


@pytest.mark.parametrize("case", CASES)
def test_stages(spark, folders, case):  # noqa: F811
    folder, rows = folders[case], documents(folders[case])
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    scored = queries.op9_toxicity(spark, folder).collect()
    toxic = Counter(r["doc_id"] for r in scored if r["predicted"])
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    assert not bag(kept) - bag(rows)
    assert Counter(r["doc_id"] for r in rows) - Counter(r["doc_id"] for r in kept) == toxic

    groups = defaultdict(list)
    for i, (doc_id, n, least) in enumerate(brute([(r["doc_id"], r["text"]) for r in rows])):
        groups[least if n else ("no words", i)].append(doc_id)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert not bag(single) - bag(rows)
    want = Counter(min((x for x in ids if x is not None), default=None) for ids in groups.values())
    assert Counter(r["doc_id"] for r in single) == want

    model = pii.fit(docs)
    want = Counter()
    for r in pii.label_spans(docs, model).collect():
        text, out, at = r["text"], [], 0
        for s, e, kind in sorted((x["s"], x["e"], x["kind"]) for x in r["spans"]):
            if s >= at:
                out += [text[at:s], f"<{pii.KINDS[kind].upper()}>"]
            at = max(at, e)
        text = text if text is None else "".join([*out, text[at:]])
        want[r["doc_id"], text, r["lang"], r["source"], None if text is None else len(text)] += 1
    assert bag(corpus_pipeline.redact_personal_data(spark, docs, folder).collect()) == want

    readings = Counter()
    for r in mixing.mix(docs).collect():
        readings[r["doc_id"], r["source"]] += r["readings"]
    mixed = Counter((r["doc_id"], r["source"]) for r in corpus_pipeline.mix_sources(spark, docs, folder).collect())
    assert mixed == +readings


@pytest.mark.parametrize("case", CASES)
def test_stages_in_turn(spark, folders, case):  # noqa: F811
    """The whole pipeline against plain Python that applies what toxicity and personal data have learned, in turn."""
    folder = folders[case]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = [r for r in toxicity.toxicity(docs, labels).collect() if not r["predicted"]]

    groups = defaultdict(list)
    for i, (doc_id, n, least) in enumerate(brute([(r["doc_id"], r["text"]) for r in clean])):
        groups[least if n else ("no words", i)].append(i)
    first = lambda i: (clean[i]["doc_id"] is None, clean[i]["doc_id"] or 0)
    single = [clean[min(ids, key=first)] for ids in groups.values()]

    kept = spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in single], docs.schema)
    redacted = pii.redacted(kept, pii.fit(kept)).collect()
    edited = spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in redacted], docs.schema)
    readings = Counter()
    for r in mixing.mix(edited).collect():
        readings[r["doc_id"], r["source"], r["size"]] += r["readings"]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in redacted:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        lead = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cuts = [0, *range(lead, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            data = b"".join(i.to_bytes(4, "little") for i in ids[a:b])
            want[r["doc_id"], piece, a, b - a, zlib.crc32(data)] += readings[r["doc_id"], r["source"], size]
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == +want
    held = Counter()
    for r in got:
        held[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 for n in held.values())
