from glyphgrid.llm import chat

BAD = ["", "plain", "<|end|>", "\\<|turn|>", "a\\", "<", "<\\|", "|>x", "\\\\|", "<|", "ends <", "\n\n", None, "é😀 <|text|>"]


def test_round_trip_of_control_strings(spark):
    rows = [(i // 3 if i else None, i % 3, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(BAD)] + [(99, None, "assistant", "x"), (99, None, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.as_parts(chat.F.col("text")))
    out = chat.format_conversations(turns)
    read = out.select("*", chat.parse_turns(chat.F.col("formatted")).alias("turns"), chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")).collect()
    expected = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0)):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read} == expected
    for r in read:
        assert r.loss == "".join(text for role, text in expected[r.conv_id] if role == "assistant")
    assert chat.format_conversations(turns.limit(0)).count() == 0
    assert sum(d.loss_chars for d in chat.digests(out).collect()) == sum(len(r.loss) for r in read)


def test_parts(spark):
    part = lambda kind, text=None, uri=None, units=None: (kind, text, uri, units)
    parts = [part("text", "see <|image|>"), part("image", uri="a.png", units=576), part("document", uri=None, units=2), part("audio", uri="c.wav"), part("odd", "kept"), part(None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(turns).first()
    assert r.formatted == "<|turn|>user<|text|>see <\\|image|><|image|><|document|><|audio|>kept<|end|><|turn|>assistant<|text|><|end|>"
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "a.png", 576), ("document", "", 512), ("audio", "c.wav", 0)]
    for a in r.attachments:
        assert r.formatted[a.start :].startswith(f"<|{a.kind}|>")
    assert r.expanded_tokens == 1088 and r.loss_spans[0].length == 0
