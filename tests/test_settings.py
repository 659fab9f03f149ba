from blockloom.operators import translate as T
from blockloom.plans.settings import substitute_env


def test_names_in_braces_are_filled():
    env = {"HOST": "h", "A_1": "x"}
    assert substitute_env("http://${HOST}/${A_1}?${NONE}&$HOST $5", env) == "http://h/x?${NONE}&$HOST $5"
    assert substitute_env(None, env) is None and substitute_env("", env) == ""


def test_a_busy_translator_is_asked_again():
    asked = []

    def fn(texts, **_):
        asked.append(list(texts))
        if len(asked) < 3:
            raise T.Busy("later")
        return [t.upper() for t in texts]

    assert T.call(fn, ["a", "b"], "", {}, waits=(0.0, 0.0)) == [("A", None), ("B", None)] and len(asked) == 3
    asked.clear()
    assert T.call(lambda t, **k: (_ for _ in ()).throw(T.Busy("never")), ["a"], "", {}, waits=(0.0,)) == [(None, "Busy: never")]
