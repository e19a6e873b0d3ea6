"""Pages written by hand, in layouts that the training generator does not make: (html, main text lines)."""

A = "The harbour town woke late that morning, and the boats stayed in the bay until noon, when the wind turned at last."
B = "Nobody could say who had rung the bell, though the sexton swore, twice and loudly, that he had been asleep."
C = "By evening the whole street had heard three versions of the story; none of them mentioned the missing ladder."
D = "The council met on Thursday, argued for two hours about the bell, and then, as usual, voted to meet again."
E = "Visitors are told to walk up the hill before breakfast, since the view is best while the mist is still lifting."

PAGES = [
    (f"<body><table width=100%><tr><td bgcolor=#eee><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td><td><h1>The bell</h1><p>{A}<p>{B}<p>{C}</td></tr></table><center><font size=1>Copyright 2003 Harbour Gazette</font></center>", ["The bell", A, B, C]),
    (f"<div class=wrapper><div class='nav-list'><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div class=post-body><h2>Mist</h2><div>{A}</div><div>{B}</div><div>{D}</div></div><div class='share-bar'><a href=#>Share</a> <a href=#>Tweet</a></div></div>", ["Mist", A, B, D]),
    (f"<main><h1>Boats</h1><p>{A}</p><figure><img src=x.jpg><figcaption>The bay at noon, seen from the hill.</figcaption></figure><p>{B}</p></main><footer><p>All rights reserved. Terms. Privacy.</p></footer>", ["Boats", A, "The bay at noon, seen from the hill.", B]),
    (f"<article><h1>Steps</h1><p>{E}</p><ol><li>Boil the water first.</li><li>Add the salt, then the herbs.</li><li>Wait for ten minutes.</li></ol><p>{D}</p></article><aside><h4>Popular</h4><a href=1>Ten soups</a><a href=2>Bread</a></aside>", ["Steps", E, "Boil the water first.", "Add the salt, then the herbs.", "Wait for ten minutes.", D]),
    (f"<div id=cookie-banner><p>We use cookies to improve your visit. By going on you agree to this.</p><button>Accept</button></div><div id=content><p>{A}</p><p>{B}</p></div>", [A, B]),
    (f"<HTML><BODY><UL CLASS=MENU><LI><A HREF=/>Start<LI><A HREF=/B>Archive</UL><H1>Upper</H1><P>{A}<P>{C}<HR><ADDRESS>Webmaster, 12 May 1998</ADDRESS></BODY></HTML>", ["Upper", A, C]),
    (f"<div class=container><section class=story><h1>Quotes</h1><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{C}</p></section><section class=comments-area><h3>3 comments</h3><div class=comment-body><p>Lovely story, thank you for it.</p></div></section></div>", ["Quotes", A, B, C]),
    (f"<article><header><h1>Head</h1></header><section><h2>Part one</h2><p>{A}</p></section><section><h2>Part two</h2><p>{B}</p></section></article><nav class=pagination><a href=1>Previous</a><a href=3>Next</a></nav>", ["Head", "Part one", A, "Part two", B]),
    (f"<div class=page><div class=breadcrumbs><a href=/>Home</a> &gt; <a href=/t>Travel</a></div><h1>Hill</h1><p>{E}</p><p>{D}</p><div class=related-posts><h3>You may also like</h3><ul><li><a href=1>Five hills</a></li><li><a href=2>Seven bays</a></li></ul></div></div>", ["Hill", E, D]),
    (f"<body><p>{A}</p><p>{B}</p><p>{C}</p></body>", [A, B, C]),
    (f"<article><h1>Numbers</h1><p>{A}</p><table><tr><th>Year</th><th>Boats</th></tr><tr><td>1990</td><td>twelve boats</td></tr></table><p>{B}</p></article>", ["Numbers", A, "Year", "Boats", "1990", "twelve boats", B]),
    (f"<main id=main-content><article class=entry><h1>Ad break</h1><p>{A}</p><div class=advertisement>Buy our new kettle today, it boils in a minute and costs little.</div><p>{D}</p></article></main>", ["Ad break", A, D]),
    (f"<div class=topbar><span>Harbour Gazette</span></div><div class=entry-content><p>{A}</p><script>var a = '<p>not text</p>';</script><style>p {{ color: red }}</style><p>{B}</p></div>", [A, B]),
    (f"<div class=article-text><p>{A}</p><p>{E}</p></div><div class=newsletter-signup><p>Sign up for our letter and never miss a story.</p><form><input name=mail><button>Join</button></form></div>", [A, E]),
    (f"<div class=main><h1>Wiki</h1><div id=toc class=toc><ul><li><a href=#a>History</a></li><li><a href=#b>Today</a></li></ul></div><p>{A}</p><h2>History</h2><p>{B}</p></div>", ["Wiki", A, "History", B]),
    (f"<article><p>{A}<p>{B}<ul><li>Ropes<li>Nets and hooks<li>A spare lamp</ul><p>{C}</article><div class=foot>Imprint</div>", [A, B, "Ropes", "Nets and hooks", "A spare lamp", C]),
    (f"<div role=navigation><a href=1>A</a><a href=2>B</a><a href=3>C</a></div><div role=main><h1>Roles</h1><p>{A}</p><p>{D}</p></div><div role=contentinfo class=footer>Contact us at the harbour office.</div>", ["Roles", A, D]),
    (f"<main><h1>Code</h1><p>{A}</p><pre>ring the bell\nrun</pre><p>{B}</p></main><footer>v1.2</footer>", ["Code", A, "ring the bell run", B]),
    (f"<div class=sidebar><h3>About</h3><p>This site is run by volunteers.</p></div><div class=content><h1>Left</h1><p>{A}</p><p>{C}</p></div>", ["Left", A, C]),
    (f"<article lang=de><h1>Die Glocke</h1><p>Niemand wusste, wer die Glocke geläutet hatte, obwohl der Küster zweimal schwor, dass er geschlafen habe.</p><p>Am Abend kannte die ganze Straße drei Fassungen der Geschichte, und in keiner kam die Leiter vor.</p></article><footer><p>Impressum und Datenschutz</p></footer>",
     ["Die Glocke", "Niemand wusste, wer die Glocke geläutet hatte, obwohl der Küster zweimal schwor, dass er geschlafen habe.", "Am Abend kannte die ganze Straße drei Fassungen der Geschichte, und in keiner kam die Leiter vor."]),
    (f"<div><div><div><div><h1>Deep</h1><p>{A}</p><p>{B}</p></div></div></div></div><div class=footer-links><a href=1>Jobs</a><a href=2>Press</a></div>", ["Deep", A, B]),
    (f"<article><h1>Select</h1><p>{A}</p><select><option>Choose a boat<option>Red boat<p>{B}</p><p>{C}</p></article>", ["Select", A, B, C]),
    (f"<article><h1>Drawing</h1><p>{A}</p><svg><text>label of a drawing</text><p>{B}</p></article><div class=copyright>2020 Harbour</div>", ["Drawing", A, B]),
    (f"<main><h1>Formula</h1><p>{A} Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>{B}</p></main>", ["Formula", f"{A} Here x=2 holds.", B]),
    (f"<header class=site-header><h2>Gazette</h2><nav><a href=1>News</a></nav></header><div class=story-body><h1>Links</h1><p>The <a href=x>harbour town</a> woke late that <a href=y>morning</a>, and the boats stayed in the bay until noon.</p><p>{D}</p></div>", ["Links", "The harbour town woke late that morning, and the boats stayed in the bay until noon.", D]),
    (f"<section class=popup-overlay><p>Wait, before you go, take ten percent off your first order with us.</p></section><article><p>{A}</p><p>{E}</p></article>", [A, E]),
    (f"<div class=post><h1>Thread</h1><p>{A}</p><p>{B}</p></div><ol class=commentlist><li class=comment><p>I was there and it was not like that at all, believe me.</p></li><li class=comment><p>So was I, and it was.</p></li></ol>", ["Thread", A, B]),
    (f"<article><h1>Entities</h1><p>Fish &amp; chips cost &pound;5, or 6&nbsp;&euro;, at the stand &mdash; and they&#39;re good, as everyone in town will tell you.</p><p>{A}</p></article>", ["Entities", "Fish & chips cost £5, or 6 €, at the stand — and they're good, as everyone in town will tell you.", A]),
    (f"<article><h1>Definitions</h1><p>{A}</p><dl><dt>Bay</dt><dd>The water in front of the town, where boats lie.</dd><dt>Sexton</dt><dd>The man who rings the bell, or says he does not.</dd></dl></article>", ["Definitions", A, "Bay", "The water in front of the town, where boats lie.", "Sexton", "The man who rings the bell, or says he does not."]),
    (f"<nav><ul><li><a href=1>Start</a></li><li><a href=2>Shop</a></li></ul></nav><main><p>{A}</p><aside class=promo><p>Our summer sale starts soon, do not miss it.</p></aside><p>{B}</p><p>{C}</p></main><footer>Harbour Gazette</footer>", [A, B, C]),
]
