"""Sentences and passages that the catalogue's phrases and the grade's signals are found in, added to the rows of a table.

The tables at hand hold invented words, so that phrases hardly occur in them.
What a row gets follows from its id; the SQL check adds the same. There is a
sentence for each detector, in their order, and a passage for each of four
styles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCES = (
    "There was no rush, no noise and no hurry at all.",
    "That’s the whole idea, they said.",
    "She did not wait, did not ask, didn't stop.",
    "Don't fear the river, fear it. Don't fear it; just fear it.",
    "Try sitting with the discomfort for a minute.",
    "You already know what follows. You already know Paris.",
    "It's the entire plan.",
    "The entire plan of ours is new.",
    "The cost is real and it hurts. This is real estate and it sells.",
    "The punchline: nobody came.",
    "That feels worth naming. It is worth naming names.",
    "That is not nothing.",
    "Here's the whole list.",
    "He walked up to the old mill. She walked up to the old barn. It rained.",
    "It failed. Honestly, we had it coming.",
    "My favorite part of the day came late.",
    "It is the only tool I trust.",
    "You don't have to take my word for it.",
    "Turns out he left early.",
    "It fits in your head, batteries included.",
    "Why us? Why now? Fine.",
    "Perhaps so. Perhaps not. Perhaps later on.",
    "We need three: red paint, blue paint, and time.",
    "Here's the twist: it worked.",
    "Printed paper is dead.",
    "That is why the vote mattered.",
    "Some left; the others never did.",
    "Certainly! Here it is. I hope this helps.",
    "In a world where time stops, we wait.",
    "They embarked on a journey, a beacon of calm.",
    "Let's dive in.",
    "A game-changing, cutting edge idea.",
    "It ended. In summary, it was good.",
    "Here's what most people get wrong.",
    "It is the worst mistake you make.",
    "Studies show it.",
    "A holistic approach to a robust framework.",
    "Her breath hitched.",
    "There is something for everyone.",
    "In order to utilise or utilize it.",
    "Generally speaking, it may potentially rain.",
    "Timing is everything.",
    "They foster care; she fosters hope and delves deep. A non-pivotal vote aligns with it.",
    "It isn't a tool, it's a habit. It's a lamp, not a mirror.",
    "It’s worth noting that it rained.",
    "It stands as a lasting testament.",
    "It played a truly vital role.",
    "The political landscape changed.",
    "Many experts believe it.",
    "Despite these many challenges, we go.",
    "It fell, highlighting the need for care.",
    "Nestled in a valley, a hidden gem.",
    "Dear [insert name], see **this note** now.",
    "It serves as a base.",
    "In connection with that, we wrote.",
    "It gained significant media coverage.",
    "The real story here is trust.",
    "A thing that no tool can measure.",
    "Yes. Moreover, it rained.",
    "It sparked a debate about rain.",
    "The official website lists it.",
    "The constellation of lights.",
    "Bold. Clear. Ready now.",
)
_LINE = "However, it is not just quick but also cheap, calm, and kind — it isn’t loud, it’s quiet. It is a plain, small, and even step for all — there is no more to it… There are two, three, and four of them — “this is it”, not a dream or a wish. These are the old, slow, and sure ways — it is not cold, it is warm in here."
_DASHES = "A long walk — a short rest — a warm, dry, and quiet place… A cup, a plate, and a spoon lay “there” — and the old, tall, and thin lamp burned on."
_OPENERS = "However, we left. It is late. Therefore, we slept. There is a road. Indeed, it bends. This is the end of it. Moreover, the cat, the dog, and the bird slept, as the sun, the moon, and the wind did."
#: Lines that a row of each style gets: none; all signs at once, in even paragraphs; dashes, triads and typography; empty and transition openers.
STYLES = ("", "\n".join([_LINE] * 8), "\n".join([_DASHES] * 5), "\n".join([_OPENERS] * 5))
#: What each second page gets before its end: hidden, editable and code parts, bold-lead lists, spans across tags, and a phrase parted by a block's edge.
HTML = (
    "<p>It just <b>works</b>, and it <i>just works</i>.</p><ul><li><strong>One</strong> thing</li><li><b>Two</b> things</li><li>Three <b>things</b></li><li>four</li></ul>",
    "<div hidden>It just works.</div><p style='display: none'>It just works.</p><pre><code>it just works</code></pre><textarea>it just works</textarea><div contenteditable>it just works</div><p>It just</p><p>works, in order to</p>",
)


def _at(key: Column, n: int, each: int = 1) -> Column:
    return F.coalesce(F.floor(F.pmod(key, F.lit(n * each)) / each), F.lit(0)).cast("int")


def seeded(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """table with lines added to text: the sentence whose number is key mod their number, and the style of every 63 keys (the first ones for null keys)."""
    line, style = F.get(F.array(*map(F.lit, SENTENCES)), _at(F.col(key), len(SENTENCES))), F.get(F.array(*map(F.lit, STYLES)), _at(F.col(key), len(STYLES), len(SENTENCES)))
    return table.withColumn(text, F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), line, F.when(style != "", F.concat(F.lit("\n"), style)).otherwise("")))


def seeded_html(pages: DataFrame) -> DataFrame:
    """pages with one of HTML before the end of the body, or at the end of html."""
    part = F.get(F.array(*map(F.lit, HTML)), _at(F.col("page_id"), len(HTML)))
    cut = F.instr("html", "</body>")
    return pages.withColumn("html", F.when(cut > 0, F.concat(F.expr("substring(html, 1, instr(html, '</body>') - 1)"), part, F.expr("substring(html, instr(html, '</body>'))"))).otherwise(F.concat("html", part)))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in values) + "]"


def seeded_sql(table: str = "documents", key: str = "doc_id") -> str:
    """The same table in SQL, with columns of the original and text replaced."""
    n, k = len(SENTENCES), len(STYLES)
    style = f"({_list(STYLES)})[coalesce(({key} % {n * k}) // {n}, 0) + 1]"
    return f"SELECT * REPLACE (coalesce(text, '') || chr(10) || ({_list(SENTENCES)})[coalesce({key} % {n}, 0) + 1] || CASE WHEN {style} = '' THEN '' ELSE chr(10) || {style} END AS text) FROM {table}"
