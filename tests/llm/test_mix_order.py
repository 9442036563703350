"""The packed sequences follow the mix, in whatever order the mixed rows are read."""

import corpus_pipeline
from tapeworks.llm import mixing


def test_sequences_follow_the_slots(spark, sf, documents):
    slot = {r.id: (r.slot, r.before) for r in mixing.schedule(documents).collect()}
    mixed = corpus_pipeline.mix_sources(spark, documents, sf)
    places = {}
    for r in corpus_pipeline.pack_sequences(spark, mixed.repartition(5, "doc_id"), sf).collect():
        places.setdefault(r.sequence_id >> 33, set()).add(slot[r.doc_id])
    runs = [places[p] for p in sorted(places)]
    assert len(runs) > 1
    assert all(max(a) < min(b) for a, b in zip(runs, runs[1:]))
