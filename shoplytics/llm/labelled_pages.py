"""Labelled pages from which the page model learns.

Written for this purpose, in the layouts that pages on the web have.  ``data-y`` marks an
element and what is in it: 1 main text, 0 anything else; without it, 0.
"""

_LONG = ("The council met on Tuesday to discuss the new bridge, and after two hours of debate it agreed to begin work in spring. "
         "Residents who spoke at the meeting asked for a safer crossing, and the plan was changed to include one.")
_MORE = "Work on the northern side will take six months, said the engineer in charge, if the weather allows it."
_SHORT = "It did."

PAGES = [
    # Semantic tags.
    f"""<html><body><header class="site-header"><h1>Daily News</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li>
    <li><a href="/s">Sport</a></li></ul></nav></header><main data-y="1"><article><h1>A new bridge</h1><p>{_LONG}</p><p>{_SHORT}</p>
    <h2>What next</h2><p>{_MORE}</p><div class="ad" data-y="0">Buy shoes now</div><blockquote><p>{_MORE}</p></blockquote><ul><li>First, the road.</li>
    <li>Then the bridge itself.</li></ul></article></main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One</a></li>
    <li><a href="/2">Two</a></li></ul></aside><footer><p>Copyright 2020 Daily News. All rights reserved.</p></footer></body></html>""",
    # Bare article between a menu and a footer.
    f"""<body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">word</a></li><li><a href="/c">other</a></li></ul></nav>
    <div class="ad">Some words of an advert that may be a sentence.</div><article data-y="1"><h1>Title of it</h1><p>{_SHORT}</p><p>{_LONG}</p></article>
    <footer>(c) www.example.org. A line of words.</footer></body>""",
    f"""<body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Der Laden.</div><article data-y="1"><h1>So.</h1><p>Ja.</p></article>
    <footer>(c) example</footer></body>""",
    # Divs with class names, comments below.
    f"""<body><div id="header" class="header"><div class="logo">Blog</div><div class="menu"><a href="/">home</a> <a href="/about">about</a></div></div>
    <div id="wrapper" class="container"><div class="post-content content" data-y="1"><h2>My trip</h2><div>{_LONG}</div><p>{_MORE}</p><pre>code = 1</pre>
    <p>{_SHORT}</p></div><div id="comments" class="comments"><h3>3 comments</h3><div class="comment"><p>Great post! I was there as well, last year in May.</p>
    </div><div class="comment reply"><p>Thank you for this, it helped me a lot.</p></div><form class="comment-form"><label>Name</label><p>Leave a reply</p>
    </form></div></div><div id="sidebar" class="sidebar widget"><h4>About me</h4><p>I write about trains and what I see from them.</p></div>
    <div id="footer" class="footer"><p>Powered by something</p></div></body>""",
    # Notices, newsletter form, related and sharing boxes inside the article.
    f"""<body><div class="cookie-notice notice banner" role="alert"><p>We use cookies to improve this site. By going on you agree.</p></div>
    <article class="story" data-y="1"><h1>Rain</h1><p>{_MORE}</p><div class="share social" data-y="0"><a href="#">Share</a> <a href="#">Tweet</a></div><p>{_LONG}</p>
    <form class="newsletter signup" data-y="0"><p>Sign up for our newsletter to get more stories like this.</p></form><p>{_SHORT}</p>
    <section class="related" data-y="0"><h3>Related stories</h3><ul><li><a href="/x">Sun is coming back</a></li></ul></section>
    <section class="comments" data-y="0"><h3>Comments</h3><div class="comment"><p>I like rain, and I do not mind what people say about it.</p></div></section>
    <aside data-y="0"><p>Subscribe for full access to all of our stories.</p></aside></article><footer class="footer"><p>Contact us</p></footer></body>""",
    # Article with its own header and footer.
    f"""<body><header><div class="brand">Site</div></header><main data-y="1"><article class="entry post"><h1>On maps</h1><section><p>{_LONG}</p><p>{_MORE}</p></section>
    <table><tr><td>Scale</td><td>Use</td></tr><tr><td>1:1000</td><td>Towns, with every house on it.</td></tr></table><figure><figcaption>An old map of the town.</figcaption></figure>
    <footer class="meta" data-y="0"><p>Posted in maps</p></footer></article></main><div class="promo advert sponsored"><p>Maps half price, only this week.</p></div>
    <div class="breadcrumb"><a href="/">Home</a> <a href="/m">Maps</a></div><div class="popup modal"><p>Join us today.</p></div></body>""",
    # Main text in plain paragraphs of a div without names.
    f"""<body><div class="nav navbar"><ul><li><a href="/">Start</a></li><li><a href="/n">News</a></li></ul></div><div data-y="1"><h1>Bread</h1><p>{_LONG}</p><p>{_MORE}</p>
    <p>{_LONG}</p></div><div class="disclaimer legal"><p>Terms and privacy. No part may be copied.</p></div><div class="ads"><p>Flour, cheap.</p></div></body>""",
    # Comments with headings, forms in the main part, lists of links after it.
    f"""<body><nav class="main-menu"><a href="/">Home</a></nav><main data-y="1"><h1>Bees</h1><p>{_LONG}</p><h2>Honey</h2><p>{_SHORT}</p><p>{_MORE}</p>
    <form data-y="0" action="/go"><p>Your name</p><p>Your mail, so that we can write to you.</p><label>Send</label></form>
    <aside class="info-box" data-y="0"><h3>Also in this issue</h3><p>Ants and what they do in winter, by our reporter.</p></aside></main>
    <section id="comments" class="comments"><h2>Comments</h2><p>What a good read this was, and so well said!</p><ol class="commentlist"><li>
    <p>I keep bees, and I can say that all of this is true.</p></li><li><div class="comment-body"><p>No.</p></div></li></ol><h2>Write a comment</h2></section>
    <section class="newsletter"><h2>Stay informed</h2><p>Get our letter every week.</p></section></body>""",
    f"""<body><div class="site-notice alert"><h2>Notice</h2><p>The site will be down on Sunday from ten to twelve.</p></div><div class="wrap"><article data-y="1">
    <h1>Salt</h1><h2>From the sea</h2><p>{_LONG}</p><h3>From the ground</h3><p>{_MORE}</p><p>{_SHORT}</p><div class="ad" data-y="0"><h3>Pans</h3><p>New pans for you.</p></div></article>
    <div class="comments-area" id="respond"><h2>2 replies</h2><article class="comment"><p>Salt is what I like most, said my father every day.</p></article><article class="comment">
    <p>Thanks.</p></article></div></div><aside><h2>Popular</h2><ul><li><a href="/p">Pepper</a></li></ul><p>Our shop has all of it.</p></aside>
    <footer><h3>About</h3><p>We write on food since 1990, and hope that you like it.</p><form><p>Search</p></form></footer></body>""",
    f"""<body><header><h2>The Paper</h2><p>News for everyone, every day of the year.</p><form class="search"><p>Search here</p></form></header><div class="story-body" data-y="1">
    <h2>Wind</h2><p>{_MORE}</p><div><p>{_LONG}</p><p>{_SHORT}</p></div><blockquote>{_SHORT}</blockquote><div class="related-links" data-y="0"><h2>Related</h2>
    <p>More on wind and weather.</p></div></div><div class="sidebar"><h2>Advert</h2><p>Kites of all sizes, and strings.</p></div></body>""",
    # Text right in the body.
    f"""<body data-y="1"><p>{_LONG}</p><p>{_MORE}</p><p>{_SHORT}</p></body>""",
    f"""<body><div role="navigation"><a href="/">One</a><a href="/2">Two</a></div><div id="main" role="main" data-y="1"><h1>Stones</h1><h2>Old</h2><p>{_MORE}</p>
    <ol><li>{_SHORT}</li><li>{_MORE}</li></ol><dl><dt>Chalk</dt><dd>A soft white stone.</dd></dl></div><div role="complementary"><p>See also what others read today.</p></div>
    <div role="contentinfo"><p>Made in 1999.</p></div></body>""",
]
