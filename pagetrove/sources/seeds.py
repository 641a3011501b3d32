"""Start URLs of a crawl."""

from pyspark.sql import DataFrame, SparkSession

# The start URLs.
START_URLS = [
    "https://stackoverflow.com/questions",
    "https://github.com/trending",
    "https://dev.to",
    "https://www.reddit.com/r/programming",
    "https://www.reddit.com/r/learnprogramming",
    "https://news.ycombinator.com",
    "https://www.freecodecamp.org/news",
    "https://www.geeksforgeeks.org",
    "https://hackernoon.com",
    "https://realpython.com",
    "https://www.codecademy.com/resources/blog",
    "https://css-tricks.com",
    "https://docs.python.org/3/",
    "https://www.tutorialspoint.com",
    "https://medium.com/tag/programming",
    "https://learn.microsoft.com/en-us/dotnet/",
    "https://www.javatpoint.com",
    "https://rust-lang.org/learn",
    "https://www.coursera.org/courses?query=programming",
    "https://www.w3schools.com",
    "https://developer.mozilla.org/en-US/docs/Web/JavaScript",
    "https://www.toptal.com/developers/blog",
    "https://martinfowler.com",
    "https://www.smashingmagazine.com/category/javascript",
    "https://www.fullstackpython.com",
    "https://developer.android.com/docs",
    "https://kotlinlang.org/docs",
    "https://reactjs.org/docs/getting-started.html",
]


def seed_source(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Column ``url``: the built-in start URLs, or the lines of a text file."""
    if path is not None:
        return spark.read.text(path).withColumnRenamed("value", "url")
    return spark.createDataFrame([(u,) for u in START_URLS], "url string")
