import re

from quillsieve.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


REPEATS = [(30, "a b c d e f g h " * 3), (31, "x " * 40), (32, "one two three four five six seven eight nine\n" * 2 + "tail " + " ".join(map(str, range(60)))), (33, "a b c d e f g h i a b c d e f g h i a b c d e f g h " + " ".join(f"w{i}" for i in range(90))), (34, " ".join("abcdefgh")), (35, "## && <b> $%|*")]


def test_counts(make, odd, sample):
    rows = odd + REPEATS + sample
    got = quality.quality(make(rows, ["N_WORDS", "kept", "lang2"])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((str(i), *base(t)) for i, t, *_ in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_adaptive_fences(make):
    """Each source is judged by its own distribution; its clean documents all stay."""
    text = lambda k, extra="": " ".join(f"word{(k * 7 + j) % 97}{extra}" for j in range(60 + k % 9))
    rows = [(k, text(k), "en", "plain") for k in range(400)] + [(1000 + k, text(k, "#"), "en", "code") for k in range(400)]
    rows += [(2000, text(3, "###"), "en", "plain"), (2001, text(4, "#"), "en", "plain"), (2002, text(3, "#"), "en", "rare")]
    kept = {r.doc_id: r.kept for r in quality.quality(make(rows)).collect()}
    assert all(v for k, v in kept.items() if k < 2000)
    assert not kept[2000] and not kept[2001]  # a symbol a word is usual in one source, not in the other
    assert kept[2002]  # a small source is judged by its language


def test_junk_inside_the_old_floors(make):
    """Junk between 0.1 and 0.4 of a clean source fails, each ratio by itself; so do words of one letter."""
    word = lambda j: f"word{j % 97}"
    line = lambda a, n: " ".join(word(a + j) for j in range(n))
    clean = lambda k: "\n".join(line(k * 7 + 9 * i, 6 + k % 3) for i in range(8))
    rows = [(k, clean(k), "en", "plain") for k in range(400)]
    marked = lambda n: " ".join(word(j) + ("#" if j < n else "") for j in range(60))
    symbols = [(1000 + n, marked(n), "en", "plain") for n in (7, 12, 23)]
    lines = [(2000 + n, "\n".join(line(3, 5) if i % 2 and i < 2 * n + 2 else line(5 + 6 * i, 6) for i in range(10)), "en", "plain") for n in (1, 2, 3)]
    repeats = [(3000, f"{line(0, 9)} {line(20, 70)} {line(0, 9)}", "en", "plain")]
    letters = [(4000, " ".join("abcdefghijklmnopqrstuvwxyz"), "en", "plain")]
    got = {r.doc_id: r for r in quality.quality(make(rows + symbols + lines + repeats + letters)).collect()}
    assert all(r.kept for i, r in got.items() if i < 1000)
    assert not any(r.base_failed for r in got.values())
    assert [i for i, r in got.items() if i >= 1000 and r.kept] == []


def test_stage_keeps_columns_and_empty(make, odd):
    df = make(odd)
    out = quality.keep_good(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {i for i, *_ in odd}
    assert quality.quality(make([])).count() == 0 and quality.keep_good(make([])).count() == 0
