"""People's histories, posts and tenures as window operations over appointment events.

Events: id, bureau, person, action (appoint or dismiss), title, dept, day (ISO text); where they have notice_title or clause
too, these texts say which rows are leaves (a retirement, or a dismissal that the action doesn't name). A null title or
department counts as an empty one, a null bureau or person as a key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import leaves_post, normalize_title, takes_post, title_sort_rank

PERSON = ["bureau", "person"]
POST = ["bureau", "dept", "title"]


def title_name(title: Column) -> Column:
    return F.coalesce(normalize_title(title)["canonical"], title)


def is_leave(events: DataFrame) -> Column:
    """Whether a row ends a post: its change type is retire or dismiss, which no earlier row decides."""
    text = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    return leaves_post(F.col("action"), text("notice_title"), text("clause"), text("title"), text("dept"))


def is_appointment(events: DataFrame) -> Column:
    """Whether a row gives a post; rows of an unknown type neither give nor end one."""
    text = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    return takes_post(F.col("action"), text("notice_title"), text("clause"), text("title"), text("dept"))


def with_previous(events: DataFrame) -> DataFrame:
    """The title and department of the person's last event that was no leave."""
    before = Window.partitionBy(*PERSON).orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    stays = ~is_leave(events)
    last = lambda c: F.last(F.when(stays, F.nullif(c, F.lit(""))), ignorenulls=True).over(before)
    return events.withColumns({"prev_title": last(F.col("title")), "prev_dept": last(F.col("dept"))})


def _first_leave(rows: DataFrame, after: bool) -> DataFrame:
    """rows (leave, n, day) with end: n and day of the first leave after, or the nearest before, that closes the row's post.

    A leave closes its own post; one with a title alone any of its title; one without a post any. That makes three windows
    within a person's rows, so they are shuffled once, and none is joined with another.
    """
    title, dept = F.coalesce("title", F.lit("")), F.coalesce("dept", F.lit(""))
    rows = rows.withColumns({"_title": title, "_dept": dept})
    order = F.desc("n") if after else F.asc("n")  # a frame that only grows: one to the end is read anew for each row
    event, pick = F.struct("n", "day"), F.min if after else F.max

    def within(keys: list[str], closes: Column) -> Column:
        return pick(F.when(F.col("leave") & closes, event)).over(Window.partitionBy(*PERSON, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    blank = (F.col("_title") == "") & (F.col("_dept") == "")
    rows = rows.withColumns({"_own": within(["_title", "_dept"], F.lit(True)), "_same": within(["_title"], (F.col("_dept") == "") & ~blank), "_any": within([], blank)})
    end = (F.least if after else F.greatest)("_own", "_same", "_any")
    return rows.withColumn("end", end).drop("_title", "_dept", "_own", "_same", "_any")


def spans(events: DataFrame) -> DataFrame:
    """Appointments with ended_on: the day of the first later leave that closes them."""
    rows = events.withColumns({"n": F.row_number().over(Window.partitionBy(*PERSON).orderBy("day", "id")), "leave": is_leave(events), "takes": is_appointment(events)})
    return _first_leave(rows, True).where("takes").select(*PERSON, "id", "title", "dept", F.col("day").alias("started_on"), F.col("end.day").alias("ended_on"))


def shown(events: DataFrame) -> DataFrame:
    """Events with n, their place in a person's history as it is shown: newest day first, on a day the highest title."""
    order = Window.partitionBy(*PERSON).orderBy(F.col("day").desc(), title_sort_rank(F.col("title")), F.col("id").desc())
    return events.withColumns({"n": F.row_number().over(order), "leave": is_leave(events), "takes": is_appointment(events)})


def _posts(events: DataFrame, *shown_too: str) -> DataFrame:
    """Per person and post (title, dept as texts): its newest leave and its newest appointment as shown, and whether that is open.

    A place as shown is day, rank and id, the newest the greatest, so a person's rows are neither numbered nor sorted: of a post's
    appointments none is open if the newest is not. The rank is the title's, so it is looked up once a post. leave, taken: their places;
    post: title, dept, day and shown_too of the appointment.
    """
    title, dept = F.coalesce("title", F.lit("")).alias("_title"), F.coalesce("dept", F.lit("")).alias("_dept")
    newest = lambda cond, *more: F.max(F.when(cond, F.struct("day", "id", *more)))
    posts = events.groupBy(*PERSON, title, dept).agg(newest(is_leave(events)).alias("_left"), newest(is_appointment(events), "title", "dept", *shown_too).alias("post"))
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.day", "_rank", f"{c}.id"))
    posts = posts.withColumn("_rank", -title_sort_rank(F.col("_title")))
    posts = posts.withColumns({"leave": place("_left"), "taken": place("post")})
    blank = (F.col("_title") == "") & (F.col("_dept") == "")
    same = F.max(F.when((F.col("_dept") == "") & ~blank, F.col("leave"))).over(Window.partitionBy(*PERSON, "_title"))
    any_ = F.max(F.when(blank, F.col("leave"))).over(Window.partitionBy(*PERSON))
    posts = posts.withColumn("_closed", F.greatest("leave", same, any_))
    return posts.withColumn("open", F.col("taken").isNotNull() & (F.col("_closed").isNull() | (F.col("taken") > F.col("_closed"))))


def current_posts(events: DataFrame) -> DataFrame:
    """Per person the first appointment as shown that no newer leave closes."""
    open_ = _posts(events).where("open").groupBy(*PERSON).agg(F.max_by("post", "taken").alias("p"))
    return open_.select(*PERSON, "p.title", "p.dept", F.col("p.day").alias("since"))


def newest_is_leave(events: DataFrame) -> DataFrame:
    """Per person whether the first row as shown, but for those of unknown types, is a leave."""
    posts = _posts(events).groupBy(*PERSON).agg(F.max("leave").alias("leave"), F.max("taken").alias("taken"))
    return posts.select(*PERSON, (F.col("leave").isNotNull() & (F.col("taken").isNull() | (F.col("leave") > F.col("taken")))).alias("newest_is_leave"))


HEAD_OFFICE = ("国家税务总局", "总局")


def people_now(events: DataFrame, duties: DataFrame, head: str | int = "sta") -> DataFrame:
    """Per person with an event or a duty: title, dept, departments, is_current, since, gender, by events and leaders' pages.

    The first open appointment as shown counts, unless the person's newest duty has a title and the appointment's unit is bare (the head
    office, in a bureau that isn't the head office itself). Then, and where no appointment is open, the duty counts; it is current if
    no leave is newer than the newest open appointment, or, without one, none is there that counts. Who has neither is not current. duties: id, bureau,
    person, title, departments (array); gender if there is one. events: unit if there is one.
    """
    leader = F.struct(*[F.col(c) if c in duties.columns else F.lit(None).cast("string").alias(c) for c in ("title", "departments", "gender")])
    led = duties.groupBy(*PERSON).agg(F.max_by(leader, "id").alias("leader"))
    unit = F.col("unit") if "unit" in events.columns else F.lit("")
    posts = _posts(events.withColumn("_unit", F.trim(F.coalesce(unit, F.lit("")))), "_unit")
    rows = posts.groupBy(*PERSON).agg(F.max_by("post", F.when(F.col("open"), F.col("taken"))).alias("post"), F.max(F.when(F.col("open"), F.col("taken"))).alias("_open"), F.max("leave").alias("_leave"))
    rows = rows.join(led, PERSON, "full")
    bare = F.col("post._unit").isin(*HEAD_OFFICE) & (F.col("bureau").cast("string") != str(head)) & (F.coalesce("leader.title", F.lit("")) != "")
    by_post = F.col("post").isNotNull() & ~F.coalesce(bare, F.lit(False))
    left = F.coalesce(F.col("_leave").isNotNull() & (F.col("_open").isNull() | (F.col("_leave") > F.col("_open"))), F.lit(False))
    title = F.when(by_post, F.coalesce(F.nullif("post.title", F.lit("")), F.col("leader.title"))).otherwise(F.col("leader.title"))
    first = F.try_element_at("leader.departments", F.lit(1))
    return rows.select(
        *PERSON, title_name(title).alias("title"), F.when(by_post, F.coalesce(F.nullif("post.dept", F.lit("")), first)).otherwise(first).alias("dept"), F.coalesce("leader.departments", F.array().cast("array<string>")).alias("departments"),
        (by_post | (F.col("leader").isNotNull() & ~left)).alias("is_current"), F.when(by_post, F.col("post.day")).alias("since"), F.col("leader.gender").alias("gender"))


def tenures(events: DataFrame, several: Column) -> DataFrame:
    """Who held each post from when to when, in windows over the post's events.

    A post one person holds ends with anybody's next appointment, one that several hold with the holder's own; a leave
    ends its person's. Appointments repeated on a day count once.
    """
    # Both windows over a holder's own events come first, dealt by holder; what is dealt by post alone is sorted once.
    first = Window.partitionBy(*POST, "person", "action", "day").orderBy("id")
    rows = events.select(*POST, "person", "action", "day", "id", several.alias("several")).repartition(*POST, "person")
    rows = rows.withColumn("again", F.row_number().over(first)).where("again = 1 OR action = 'dismiss'").drop("again")
    # From the last event back, so that frames only grow: one to the end is read anew for each row of a post.
    back = lambda *keys: Window.partitionBy(*POST, *keys).orderBy(F.desc("day"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    stays, event = F.col("action") != "dismiss", F.struct("day", "id", "person", "action")
    nearest = lambda cond, w: F.last(F.when(cond, event), ignorenulls=True).over(w)
    rows = rows.withColumn("own", nearest((F.col("several") | ~stays) & F.col("action").isNotNull(), back("person")))
    rows = rows.withColumn("_whose", F.when(F.col("several"), F.col("person")))  # a post that several hold is dealt by its holders
    rows = rows.withColumn("any", nearest(stays, back("_whose"))).where(stays)
    rows = rows.withColumn("end", F.when(F.col("several"), F.col("own")).otherwise(F.least("any", "own")))
    why = F.when(F.col("end").isNull(), None).when(F.col("end.action") == "dismiss", "dismiss").when(F.col("end.person") == F.col("person"), "replaced").otherwise("succeeded")
    return rows.select(*POST, "person", "id", F.col("day").alias("started_on"), F.col("end.day").alias("ended_on"), F.col("end").isNull().alias("is_current"), why.alias("end_change_type"))


def incumbents(tenures: DataFrame, names: int = 6) -> DataFrame:
    """Per post: present and past holders, and the first names of the present ones."""
    now = F.when(F.col("is_current"), F.col("person"))
    return tenures.groupBy(*POST).agg(
        F.count_if("is_current").alias("incumbents"), F.count_if(~F.col("is_current")).alias("past"),
        F.array_join(F.slice(F.array_sort(F.collect_set(now)), 1, names).cast("array<string>"), "、").alias("names"))
