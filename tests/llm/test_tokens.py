from hypothesis import given, settings
from hypothesis import strategies as st

from gigmatch.llm import packing, token_counts
from gigmatch.llm.words import default_vocabulary, is_plain, words

letters = st.lists(st.sampled_from([1, 2, 3]), min_size=1, max_size=5).map(tuple)


def greedy(symbols, first, later):
    """Number of longest-match pieces, tried out piece by piece."""
    at, n = 0, 0
    while at < len(symbols):
        pieces = first if at == 0 else later
        size = max((k for k in range(1, len(symbols) - at + 1) if tuple(symbols[at : at + k]) in pieces), default=0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(letters, min_size=1, max_size=8), st.sets(letters, max_size=8), st.lists(st.sampled_from([1, 2, 3]), max_size=12))
def test_automaton_equals_greedy(first, later, symbols):
    assert token_counts.Automaton(first, later).count(symbols) == greedy(symbols, first, later)
    assert token_counts.Automaton(first).count(symbols) == greedy(symbols, first, first)


def test_counts_on_documents(spark, sf1):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.op3_longest_match_token_counts(spark, sf1).collect()}
    pieces = set(token_counts.load_pieces(default_vocabulary()))
    docs = spark.read.parquet(f"{sf1}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs[::50]:
        found = words(r.text)
        assert got[r.doc_id] == (len(found), sum(greedy([*w.encode(), token_counts.STOP], pieces, pieces) for w in found))


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.count_tokens(odd).collect()]
    assert len(got) == odd.count() and {(3, 0, 0), (4, 0, 0), (5, 0, 0), (None, 0, 0)} <= set(got)
    assert token_counts.count_tokens(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("'s’ Σςİ½東é<|>\x1c\x85")), max_size=40))
def test_encoder_equals_tokenizer(text):
    encoder = packing.held("test", lambda: packing.Encoder(default_vocabulary()))
    text = text.replace("\x00", "")
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert is_plain("plain text, é") and not is_plain("<|endoftext|>")


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 20)
    encoder = packing.Encoder(default_vocabulary())
    texts = [f"word{i} common common other{i}" for i in range(60)]
    for text in texts:
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
