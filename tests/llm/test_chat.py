import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanwarden.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, cost int"


def turns(seed):
    rng = random.Random(seed)
    odd = ["</s>", "<s>", "[INST]", "[/INST]", "<\\/s>", "[\\\\INST]", "<<SYS>>", "\\", "<", "ü𝄞", "\n", None, ""]
    rows = []
    for c in [None, *range(12)]:
        k = 0
        if rng.random() < 0.6:
            rows.append((c, k, "system", "be " * rng.choice([1, 5, 40])))
            k = 1
        for _ in range(rng.choice([1, 3, 30, 90])):
            text = rng.choice([*odd, " ".join(rng.choice([*[o for o in odd if o], "word"]) for _ in range(rng.choice([2, 20, 60, 400])))])
            rows.append((c, k, rng.choice(["user", "assistant", "tool</s>", None]), text))
            k += rng.choice([1, 1, 0, 300])
    rows.append((20, None, "user", "no number"))
    rows += [(20, 3, "assistant", "twice")] * 2
    return [(*r, "w", 1) for r in rows]


def brute(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(2048, 256), (120, 30), (40, 0)])
def test_round_trip(spark, budget, history):
    rows = turns(budget)
    shown = chat.windows(spark, spark.createDataFrame(rows, SCHEMA), budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(shown).collect()}
    assert got == brute(rows)
    costs = {}
    for r in shown.collect():
        assert r.over_budget == (r.tokens > budget)
        own = [t.at for t in r.turns if not t.repeated]
        again = [t.at for t in r.turns if t.repeated]
        assert own == list(range(r.window, r.window + len(own)))
        assert [a for a in again if a] == list(range(r.window - len([a for a in again if a]), r.window))[: len(again)] or not [a for a in again if a] or max(again) == r.window - 1
        assert len(r.formatted.split("[/INST]</s>")) == len(r.turns) + 1
        if r.over_budget:
            assert len(own) == 1 or budget <= 120
        costs.setdefault(r.conv_id, []).append(r.tokens)


def test_windows_keep_system_and_mask_history(spark):
    rows = [(1, 0, "system", "rules"), *((1, k, ["assistant", "user"][k % 2], f"t{k} " * 20) for k in range(1, 40))]
    shown = chat.windows(spark, spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA), 200, 60).orderBy("window").collect()
    assert len(shown) > 5
    assert all(r.formatted.startswith("<s>system[INST]rules[/INST]</s>") and not r.over_budget for r in shown)
    later = shown[3]
    assert any(t.repeated and t.at > 0 for t in later.turns)
    masked = "".join(later.formatted[s.start : s.end] for s in later.loss)
    repeated = [t.at for t in later.turns if t.repeated and t.at]
    assert masked and not any(f"t{k} " in masked for k in repeated)


def test_escape_is_reversible(spark):
    rng = random.Random(3)
    bits = ["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "<SYS>>", "$1", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("b", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.b == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_empty(spark):
    assert chat.read_back(chat.windows(spark, spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_conversation_holds_most_turns_and_names_that_clash(spark):
    """A conversation of many blocks, one very long turn, and columns named like those of the plan."""
    rows = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"turn {t} " + "w " * (t % 40)) for t in range(1500)]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "long " * 60_000), (3, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("window", "block", "c", "s", "salt", "at"):
        df = df.withColumn(name, F.lit("x"))
    shown = chat.windows(spark, df)
    got = {r.conv_id: r for r in chat.read_back(shown).collect()}
    for conv in (1, 2, 3):
        said = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        whole = "".join(f"{a}\n{b}\n" for a, b in said)
        assert got[conv].n_turns == len(said) and got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[conv].loss_chars == sum(len(b) for a, b in said if a == "assistant")
    assert shown.filter("conv_id = 1 and not over_budget and instr(formatted, '<s>system') = 1").count() == shown.filter("conv_id = 1").count()
