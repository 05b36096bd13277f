from lanternfold.functions.html import read_page


def test_noise_subtrees_vanish():
    title, plain, marked = read_page(
        "<html><head><title> T </title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav>"
        "<script>var a='</p>';</script><header><h1>gone</h1></header><p>kept</p>"
        "<div class='x Cookie-Bar'><div>no</div></div><div id=gdpr>no</div>after<footer>no</footer></body></html>")
    assert title == "T"
    assert plain == ["T", "kept", "after"] == marked


def test_headings_and_inline_breaks():
    title, plain, marked = read_page("<h1>A <b>b</b></h1><p>x <b>y</b> z<br>w</p><h3></h3><h5>plain</h5>")
    assert title == "Ab"
    assert plain == ["A", "b", "x", "y", "z", "w", "plain"]
    assert marked == ["## A b", "x", "y", "z", "w", "plain"]


def test_entities_comments_and_stray_tags():
    _, plain, _ = read_page("a &amp; b&nbsp;c<!-- x -->d</i>e < f <img alt='a>b'>g<div data-class='cookie'>h</div>")
    assert plain == ["a & b c", "de < f", "g", "h"]


def test_implied_ends_limit_noise():
    assert read_page("<p class=newsletter>no<p>yes")[1] == ["yes"]
    assert read_page("<ul><li id=cookie>no<li>yes</ul>")[1] == ["yes"]
    assert read_page("<body class='gdpr'><p>all gone</p></body>")[1] == []


def test_title_and_textarea_hold_text_not_markup():
    title, plain, _ = read_page("<title>a <b>&amp; c</title><textarea><nav>x</textarea><iframe></nav>no</iframe><p>y")
    assert title == "a <b>& c" and plain == ["a <b>& c", "<nav>x", "y"]


def test_title_falls_back_to_h1():
    assert read_page("<title></title><h1>x <i>y</i></h1>")[0] == "xy"
    assert read_page("<p>none</p>")[0] == ""


def test_text_after_self_closed_raw_elements_stays():
    from lanternfold.functions.html import read_page

    assert read_page('<p>a</p><iframe src="x"/><p>b</p>')[1] == ["a", "b"]
    assert read_page('<script src="x"/><p>b</p><style/>c')[1] == ["b", "c"]
    assert read_page("<p>a</p><iframe src=x>inner</iframe><p>b</p>")[1] == ["a", "b"]
