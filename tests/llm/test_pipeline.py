import itertools

import pytest

import corpus_pipeline
from framewright.llm import quality, rules, secrets
from framewright.llm.shared import materialize


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], d), name)[0])
    return out


def test_each_stage_by_a_plain_version(spark, stages):
    from test_packing import check
    from test_simhash import brute_sets, jaccard

    docs, classed, ruled, single, clean, packed = stages
    ids = [{r.doc_id: r for r in s.collect()} for s in (docs, classed, ruled, single, clean)]
    assert all(s.columns == docs.columns for s in stages[1:5])
    net = quality.trained(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    scores = net.score([r.text for r in ids[0].values()])
    assert {d for d, s in zip(ids[0], scores) if s >= quality.THRESHOLD} == set(ids[1])
    failed = {d for d, r in ids[1].items() if (x := rules.statistics([r.text]).iloc[0]).n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words}
    assert not failed & set(ids[2]) and len(ids[2]) >= 0.95 * (len(ids[1]) - len(failed))
    order = sorted(ids[2])
    sets = brute_sets([ids[2][d].text for d in order])
    owner = dict(zip(order, order))
    for (i, x), (j, y) in itertools.combinations(zip(order, sets), 2):  # near copies of five-word shingles
        if owner[i] != owner[j] and jaccard(x, y) >= 0.8:
            lo, hi = sorted((owner[i], owner[j]))
            owner = {d: lo if o == hi else o for d, o in owner.items()}
    least = set(owner.values())
    assert least <= set(ids[3]) and len(set(ids[3]) - least) <= 0.02 * (len(order) - len(least))
    assert all(ids[3][d] == ids[0][d] for d in ids[3])
    assert set(ids[4]) == set(ids[3])
    assert all(r.text == secrets.redact(ids[3][d].text) and r.n_chars == len(r.text) for d, r in ids[4].items())
    got, per, places, want = check(clean)
    assert set(per) == set(ids[4]) and {r.doc_id for r in packed.collect()} == set(ids[4])


def test_most_clean_documents_stay(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    before, after = (s.join(labels, "doc_id").count() for s in stages[:2])
    assert after >= 0.96 * before


def test_odd_rows(spark, odd, none):
    d = "/root/testdata/sf0.001"
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert set(stage(spark, docs, d).columns) == set(docs.columns)
            stage(spark, docs, d).count()
        clash = docs.withColumnsRenamed({"kept": "Stats", "fp": "verdict", "n_chars": "row__"})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, clash, d).columns == clash.columns
            stage(spark, clash, d).write.format("noop").mode("overwrite").save()
        corpus_pipeline.STAGES[-1][1](spark, docs, d).count()
