from casegraph.llm import chat


def test_perspectives_of_a_group(spark):
    rows = [("c", 1, "ann", "hi <|end|>"), ("c", 0, "system", "be kind"), ("c", 2, "bo", "hello"), ("c", 2, "cy\nx", None), ("c", 3, "ann", ""),
            ("c", 3, "ann", ""), ("d", 0, "system", "alone"), (None, 0, "ann", "lost"), ("e", None, None, "who"), ("e", 0, "", "me"), ("f", 0, "bo", "y" * 100_000)]
    frame = spark.createDataFrame([(*r, "p", 5, 9) for r in rows], "conv_id string, turn long, role string, text string, piece string, size int, rank int")
    got = chat.perspectives(frame).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {("c", "ann"), ("c", "bo"), ("c", "cy x"), ("e", "unknown"), ("f", "bo")}
    for key in {(r.conv_id, r.perspective) for r in got}:
        own = sorted((r for r in got if (r.conv_id, r.perspective) == key), key=lambda r: r.position)
        whole = "".join(r.segment for r in own)
        assert [r.position for r in own] == list(range(len(own)))
        for r in own:
            assert whole[r.seg_start: r.seg_end] == r.segment
            if r.shown_as == "assistant":
                assert r.speaker == key[1] and whole[r.mask_start: r.mask_end].endswith("<|end|>")
                assert whole[: r.mask_start].endswith("<|assistant|>\n")
            else:
                assert r.mask_start is None and r.mask_end is None
    ann = sorted((r for r in got if r.perspective == "ann"), key=lambda r: r.position)
    assert "".join(r.segment for r in ann) == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi <\\|end|><|end|>\n<|user|>\nbo: hello<|end|>\n<|user|>\ncy x: <|end|>\n"
        "<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n")


def test_one_long_conversation_spans_pieces(spark):
    rows = [("hot", k, "ab"[k % 2], f"m{k}") for k in range(3000)] + [(f"c{k}", 0, "a", "x") for k in range(300)]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(8))
    own = sorted((r for r in got.filter("conv_id = 'hot' AND perspective = 'a'").collect()), key=lambda r: r.position)
    assert [r.turn for r in own] == list(range(3000)) and own[0].seg_start == 0
    assert all(a.seg_end == b.seg_start for a, b in zip(own, own[1:]))


def test_plan_is_native(spark):
    rows = spark.createDataFrame([("c", 0, "a", "x")], "conv_id string, turn long, role string, text string")
    plan = chat.perspectives(rows)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_empty(spark):
    assert chat.perspectives(spark.createDataFrame([], "conv_id string, turn long, role string, text string")).count() == 0
