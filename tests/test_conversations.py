"""Both JSON forms of evaluation conversations: order, what is dropped, coerced, and every problem."""

import json

from factgraph.sources import conversations as C


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_numbered_sessions(spark, tmp_path):
    items = [
        {"sample_id": "a", "conversation": {
            "speaker_a": "Ann", "session_10": [{"speaker": "Ann", "dia_id": "D10:1", "text": "later"}], "session_2_date_time": "3 June, 2023",
            "session_2": [{"speaker": "Bo", "dia_id": "D2:1", "img_url": "x"}, {"speaker": "Ann", "dia_id": "D2:2", "text": "hello"}, {"text": " "}, {"speaker": "Bo", "text": "hi"}, "odd", {"text": "who?"}],
            "session_3": "nothing"},
         "qa": [{"question": "q0", "answer": "x", "category": 4, "evidence": ["D2:2"]}, {"question": "q1", "answer": 2020, "category": "2", "evidence": "D10:1"},
                {"question": "q2", "adversarial_answer": "no", "answer": "yes", "category": 5}, {"question": "q3", "category": 5}, {"question": "q4", "answer": "x", "category": 9},
                {"answer": "x", "category": "one"}, {"question": "q6", "category": 1}]},
        {"sample_id": 7, "conversation": {"session_1": [{"speaker": "Ann", "img_url": "x"}]}, "qa": []},
        {"sample_id": "c", "conversation": {"note": 1}, "qa": "none"}, {"sample_id": "d", "conversation": []}, {"conversation": {}}]
    (tmp_path / "one.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, items)))
    for name, multi in (("one.json", True), ("lines.json", False)):
        got = C.numbered_sessions(spark, f"{tmp_path}/{name}", multi)
        assert rows(got.turns, "haystack_id", "session", "place", "turn_id", "speaker", "text", "timestamp") == sorted([
            ("a", 2, 0, "D2:2", "Ann", "hello", "3 June, 2023"), ("a", 2, 1, None, "Bo", "hi", "3 June, 2023"), ("a", 2, 2, None, None, "who?", "3 June, 2023"),
            ("a", 10, 0, "D10:1", "Ann", "later", None)], key=repr)
        assert rows(got.questions, "question_id", "category", "gold", "coerced", "evidence", "declines") == sorted([
            ("a:q0", "single-hop", "x", False, ["D2:2"], False), ("a:q1", "temporal-reasoning", "2020", True, ["D10:1"], False),
            ("a:q2", "adversarial", "no", False, [], True), ("a:q3", "adversarial", "", False, [], True), ("a:q6", "multi-hop", "", False, [], False)], key=repr)
        assert rows(got.problems, "item", "problem") == sorted([
            ("?", "no sample_id"), ("d", "conversation is not an object"), ("c", "no sessions"), ("7", "no turn with a text"), ("c", "qa is not a list"), ("d", "qa is not a list"),
            ("a.session_3", "session is not a list"), ("a.session_2:4", "turn is not an object"), ("a.session_2:5", "no speaker"), ("a:q5", "category is not an integer"),
            ("a:q4", "unknown category"), ("a:q6", "no answer"), ("a:q5", "no question")], key=repr)
        assert rows(got.notes, "note", "n") == [("coerced answers", 1), ("dropped turns without a text", 3)]


def test_parallel_sessions(spark, tmp_path):
    def turn(role, content, **more):
        return {"role": role, "content": content, **more}

    items = [
        {"question_id": "a", "question_type": "multi-session", "question": "q", "answer": 3, "haystack_session_ids": ["s", "t"], "haystack_dates": ["d1"],
         "haystack_sessions": [[turn("user", "one", has_answer=True), turn("narrator", "two")], [turn("user", " "), turn("assistant", "three", has_answer=True)]]},
        {"question_id": "b_abs", "question_type": "knowledge-update", "question": "q", "haystack_sessions": [[turn("user", "x", has_answer=False)], [], "odd"]},
        {"question_id": "c", "question_type": "multi-session", "question": "q", "haystack_session_ids": ["s"], "haystack_sessions": [[], []]},
        {"question_id": "d", "question_type": "other", "question": "q", "haystack_sessions": []}, {"question_type": "multi-session"},
        {"question_id": "e", "question_type": "multi-session", "haystack_sessions": "none"}]
    (tmp_path / "two.json").write_text(json.dumps(items))
    got = C.parallel_sessions(spark, f"{tmp_path}/two.json")
    assert rows(got.turns, "haystack_id", "session_id", "place", "turn_id", "speaker", "text", "timestamp") == sorted([
        ("a", "s", 0, "s:0", "user", "one", "d1"), ("a", "s", 1, "s:1", "narrator", "two", "d1"), ("a", "t", 1, "t:1", "assistant", "three", None),
        ("b_abs", "session_0", 0, "session_0:0", "user", "x", None)], key=repr)
    assert rows(got.questions, "question_id", "gold", "coerced", "evidence", "declines") == sorted([("a", "3", True, ["s:0", "t:1"], False), ("b_abs", "", False, [], True)], key=repr)
    assert rows(got.problems, "item", "problem") == sorted([
        ("?", "no question_id"), ("d", "unknown question_type"), ("e", "haystack_sessions is not a list"), ("d", "no sessions"), ("c", "ids and sessions differ in length"),
        ("b_abs.2", "session is not a list"), ("b_abs.1", "no turns"), ("a.1:0", "content is empty or not a string"), ("e", "no question")], key=repr)
    assert rows(got.notes, "note", "n") == [("role narrator", 1)]
