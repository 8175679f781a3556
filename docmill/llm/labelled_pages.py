"""Small pages whose main text is marked: between the comments main and /main lies what an extractor should keep."""

PAGES = (
    """<html><head><title>Harbour works</title><style>p{color:red}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li>
    <li><a href="/about">About us</a></li></ul></nav><div class="ad">Buy two get one free this week only</div><!--main--><article><h1>Harbour works begin</h1>
    <p>The town began to dredge the old harbour on Monday.</p><p>Work will take <b>two years</b>, the council said.<br>Ferries keep running.</p><h2>Costs</h2>
    <p>The state pays half.</p><blockquote>We waited long for this day.</blockquote></article><!--/main--><footer>&copy; 2020 The Gazette &middot; Imprint</footer></body></html>""",
    """<body><header><a href="/">Daily</a><form><input><button>Search</button></form></header><div class="cookie-notice">We use cookies. <button>Accept</button></div>
    <div id="content"><!--main--><h1>Rain ahead</h1><p>Clouds gather in the west.</p><p>Take an umbrella.</p><ul><li>Monday: rain</li><li>Tuesday: dry</li></ul>
    <!--/main--></div><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>
    <section class="comments"><h3>Comments</h3><p>First!</p><p>Nice weather here.</p></section><footer><p>Contact us by post</p></footer></body>""",
    """<html><body><div class="menu"><a href="/a">A</a> <a href="/b">B</a> <a href="/c">C</a></div><main><!--main--><section><h2>On bread</h2><p>Flour, water, salt.</p>
    <pre>knead well</pre><p>Wait a night.</p><table><tr><td>Flour</td><td>500 g</td></tr></table></section><!--/main--></main>
    <form action="/join"><p>Join our newsletter</p><input type="text"></form><div class="promo">Great offers</div><footer>Terms and privacy</footer></body></html>""",
    """<html><body><nav><a href="/x">Shop</a><a href="/y">Cart</a></nav><!--main--><article><h1>Short note</h1><p>All is well.</p></article><!--/main-->
    <div class="related"><p><a href="/r">See also this</a></p><p><a href="/s">And that</a></p></div><div class="ad">Sponsored: new shoes</div><footer>&copy; Notes</footer></body></html>""",
    """<!doctype html><html><head><title>On tides</title><meta charset="utf-8"><body class="single has-sidebar"><div id="page"><div class="masthead"><a href="/">Coast log</a></div>
    <div class="layout-with-sidebar"><main><!--main--><article class="post tags-sea social"><header><h1>On tides</h1><p>By A. Bell</p></header><p>Twice a day the sea comes up the wall.</p>
    <p>We mark its height <em>by hand</em>, as we always did, and write it down.</p><figure><figcaption>The wall at noon</figcaption></figure><h2>Since May</h2><p>It was never so high.</p></article><!--/main--></main>
    <div class="widget recent"><h3>Recent</h3><ul><li><a href="/1">Boats</a></li><li><a href="/2">Nets</a></li></ul></div></div><div id="comments"><article class="comment"><p>Lovely.</p></article>
    <article class="comment"><p>I saw it too.</p></article></div><div class="site-footer">Coast log, all rights</div></div></body></html>""",
    """<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Top</a> | <a href=/map>Map</a> | <a href=/help>Help</a></td></tr><tr><td class="menu"><a href=/1>One</a><br><a href=/2>Two</a><br>
    <a href=/3>Three</a></td><td><!--main--><h2>Old mill</h2><p>The mill was built of brick in the year of the flood, and it has stood since.<p>Its wheel turned until the river was moved.
    <p>Visitors may go in on Sundays.<!--/main--></td></tr></table><center><font size=1><a href=/c>Contact</a> Last changed in June</font></center></body></html>""",
    """<html><body><div class="topbar"><a href="/">Docs</a><a href="/api">API</a></div><div class="breadcrumbs"><a href="/">Home</a> / <a href="/g">Guide</a></div><div class="sidebar"><ul><li><a href="/i">Install</a></li>
    <li><a href="/u">Use</a></li></ul></div><div role="main"><!--main--><section><h1>Install</h1><p>Unpack the archive and run the script that lies in it.</p><pre>sh setup.sh</pre><ol><li>Choose a folder.</li><li>Wait.</li></ol>
    <p>Then read the next chapter.</p></section><!--/main--></div><div class="pager"><a href="/p">Previous</a><a href="/n">Next</a></div><footer>Built with care</footer></body></html>""",
    """<html><body><div class="cookie-consent"><p>This site uses cookies to count visits.</p><button>Fine</button></div><div class="nav-wrapper"><nav><a href="/a">News</a><a href="/b">Sport</a></nav></div><div class="story-body"><!--main-->
    <h1>Bridge closed</h1><p class="lead">The bridge over the valley was closed on Friday after a check found cracks.</p><p>It may take weeks to mend, said the office for roads.</p><!--/main--><div class="ad-slot">Cheap tyres here</div><!--main-->
    <p>Buses go round by the lake.</p><!--/main--></div><div class="share-buttons"><a href="#">Share</a><a href="#">Mail</a></div><div class="newsletter"><form><p>Get our letter every morning</p><input></form></div>
    <aside><h4>More</h4><p><a href="/x">Lake road full</a></p></aside><footer><p>Imprint, privacy, terms</p></footer></body></html>""",
)
