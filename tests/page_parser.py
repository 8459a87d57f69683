"""A parser of document files for tests, which stands for one of PDF files."""


def lines_of_pages(data):
    """A parser: the first line is the title, form feeds part pages."""
    text = data.decode()
    title, _, body = text.partition("\n")
    return title, body.split("\f") if body else []
