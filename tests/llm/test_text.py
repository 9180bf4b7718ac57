import pytest

from thermocline.llm.text import own_prose, words

PLAIN = "The gate near Jipra-58 was lost again today; and so was the lamp"


@pytest.mark.parametrize(
    "text",
    [
        "the GATE near jipra 58 was lost again today and so was the lamp",
        "> The gate near Jipra-58\n> was lost again today;\n> and so was the lamp",
        "> | The gate near <b>Jipra</b>-58<br>was&nbsp;lost again&amp;nbsp;today;\r\n| and so was the lamp",
        "[b]The gate[/b] near\tJipra–58 was l­o​st again today — and so was the lamp",
        "The ǵate néar Jipra-58 was lost again today (and) so was the lamp",
        "<p>The gate near Jipra-58 was lost again today; and so</p><p>was the lamp</p>",
    ],
)
def test_words_are_the_same(text):
    assert words(text) == words(PLAIN)


def test_words_of_nothing():
    assert words(None) == words("") == words("<br>... !") == []
    assert len(words("a b " * 200_000)) == 400_000
    assert words("Straße ŒUVRE ﬁne ４２") == ["strasse", "œuvre", "fine", "42"]
    assert words("1 < 2 and 3 > 2") == ["1", "2", "and", "3", "2"]


@pytest.mark.parametrize(
    ("text", "own"),
    [
        ("[quote=a]x [quote=b]y[/quote] z[/quote]\n\nMine here.", "Mine here."),
        ("[quote=a][quote=b]cut\n[...][/quote]\n\nMine here.", "Mine here."),
        ("[quote=a]never closed\n\nMine here.", "Mine here."),
        ("<blockquote>a said:<br>x</blockquote><br>\nMine here.", "Mine here."),
        ("joe wrote:\n> theirs\n> | more\n\nMine here.", "Mine here."),
        ("joe a écrit :\n| theirs\n\nMine here.", "Mine here."),
        ("[quote=a]x\n> theirs[/quote]\nMine here.", "Mine here."),
        ("Mine here.\n-- \njoe of Town", "Mine here."),
        ("Mine here.\n___\njoe | Town 1999", "Mine here."),
        ("Mine here.\n\n~ joe_5 ~", "Mine here."),
        ("Mine here.<br>--<br><i>The lamp.</i>", "Mine here."),
        ("Mine here.\n[size=1]x[/size]", "Mine here."),
        ("Mine here.\n[code]\nERR a_b/c retry=1\n[/code]", "Mine here."),
        ("<p>Mine here.</p><pre>x = 1</pre>", "Mine here."),
        ("Mine here.\n\nException: FooTimeout at Bar:12\n/srv/a/b-c.properties\na.b = 27b98d15", "Mine here."),
        ("[quote=a]all theirs[/quote]", ""),
        (None, ""),
        ("", ""),
    ],
)
def test_own_prose(text, own):
    assert own_prose(text) == own
