"""The text of a mix: its blocks, and the pieces of documents in the mixing stage."""

from collections import Counter

from tabloom.llm import mixing


def words(text):
    return (text or "").encode().split()


def test_blocks_and_documents(spark, docs, no_docs):
    small = docs.filter("doc_id is null or doc_id <> 706")
    for data in (small, small.repartition(3)):
        mix = mixing.Mix(data, block_words=16, per_shard=40)
        counts, blocks, out = mix.counts().collect(), mix.blocks().collect(), mix.documents().collect()
        goal, words_of = {r.source: int(r.target) for r in counts}, Counter()
        assert len({(r.source, r.slot) for r in blocks}) == len(blocks) == mix.slots.count()
        for r in blocks:
            assert len(words(r.text)) == r.words <= 16
            words_of[r.source] += r.words
        assert words_of == +Counter(goal)
        in_blocks, in_docs = Counter(), Counter()
        for r in blocks:
            in_blocks.update((r.source, w) for w in words(r.text))
        taken, by_id = Counter(), Counter()
        for r in out:
            in_docs.update((r.source, w) for w in words(r.text))
            taken[r.doc_id] += len(words(r.text))
            assert r.n_chars == (None if r.text is None else len(r.text))
        for r in counts:
            by_id[r.doc_id] += r.taken
        assert in_blocks == in_docs and +taken == +by_id
        assert any(r.size and r.taken % r.size for r in counts)  # half a document is half a document
        whole = {}
        for r in mix.pieces().collect():
            whole.setdefault((r.source, r.mix_chunk_, r.mix_nth_), []).append((r.mix_block_, r.mix_a_, r.text))
        assert Counter("".join(p[2] for p in sorted(x)) for x in whole.values()) == Counter(r.text for r in small.collect() if words(r.text))
    assert mixing.Mix(no_docs).blocks().count() == 0 and mixing.Mix(no_docs).documents().columns == no_docs.columns
