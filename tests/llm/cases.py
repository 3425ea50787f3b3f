"""Documents with every awkward case, and plain helpers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, class string, shard int, target string, edge long, n long, id long, copies long"
SPACE = r"[^\x20\x09-\x0D]+"


def words(text, pattern=SPACE):
    return re.findall(pattern, text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def awkward(seed=3, with_null_id=True):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    base, passage = prose(300), prose(60)
    texts = [None, "", "   \n\t ", "one", "two words", prose(19), prose(20), prose(21), base, base, base, prose(9)]
    for i in range(14):  # near copies of one base
        w = base.split(" ")
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    for i in range(12):  # one passage in many texts
        texts.append(prose(rng.randint(5, 200)) + " " + passage + " " + prose(rng.randint(5, 200)))
    texts += [passage, passage + " " + passage, "x " * 5000, prose(6000), "Über ÉTÉ\x0bA\x0cB c d", "a.b@c.d +1 (564) 555-4526 1.2.3.4", "tie " * 4, "tie " * 5]
    texts += [prose(rng.randint(1, 80)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(8, base), (3, "one"), (200, base.upper())]
    if with_null_id:
        rows.append((None, base))
    return [(i, t, ("en", "de", None)[k % 3], ("s1", "s2", "ü", None)[k % 4], len(t or ""), "r", "s", "c", k, "t", k, k, k, k) for k, (i, t) in enumerate(rows)]
