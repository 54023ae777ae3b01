"""Terms of posts: succession, replacement, leaves, days that repeat, departments by name."""

from officium.operators import archive

EVENT = "id long, bureau string, person string, action string, title string, dept string, day string"


def terms(spark, rows, *asked):
    events = spark.createDataFrame([(i, "b", *r) for i, r in enumerate(rows)], EVENT)
    found = archive.post_archive(events, "b", *asked) if asked else archive.archives(events)
    return sorted((r["person"], r["title"], r["since"], r["ended_on"], r["end_change_type"], r["is_current"]) for r in found.collect())


def one_by_one(rows):
    """The fold of one department in plain Python."""
    held, past, seen = {}, [], set()
    for i, (person, action, title, _, day) in sorted(enumerate(rows), key=lambda x: (x[1][4], x[0])):
        if (person, action, title, day) in seen:
            continue
        seen.add((person, action, title, day))
        if action == "dismiss":
            if person in held:
                past.append((person, *held.pop(person), day, "dismiss", False))
            continue
        if "副" not in title:
            for other in [p for p in held if p != person and held[p][0] == title]:
                past.append((other, *held.pop(other), day, "succeeded", False))
        if person in held and held[person][1] != day:
            past.append((person, *held[person], day, "replaced", False))
        held[person] = (title, day)
    return sorted(past + [(p, *h, None, None, True) for p, h in held.items()], key=lambda x: tuple(map(repr, x)))


def test_terms_follow_the_fold(spark):
    people, titles = ["王一甲", "李明", "赵大力"], ["科长", "副科长"]
    rows = [(people[(i * 7 + i // 5) % 3], "dismiss" if i % 6 == 5 else "appoint", titles[(i // 2) % 2], "法制科", f"2020-{1 + i // 4:02}-01") for i in range(36)]
    assert sorted(terms(spark, rows), key=lambda x: tuple(map(repr, x))) == one_by_one(rows)


def test_exact_departments_come_first(spark):
    rows = [("王一甲", "appoint", "科长", "法制科", "2020-01-01"), ("李明", "appoint", "科长", "第二法制科", "2020-02-01"), ("赵大力", "appoint", "法制科科长", None, "2020-03-01"), ("关于任免", "appoint", "科长", "法制科", "2020-04-01")]
    assert [t[0] for t in terms(spark, rows, "法 制科")] == ["王一甲"]
    assert [t[0] for t in terms(spark, rows, "法制")] == ["李明", "王一甲", "赵大力"]
    assert terms(spark, rows, "征管科") == [] and terms(spark, rows, "法制科", "局长") == []
