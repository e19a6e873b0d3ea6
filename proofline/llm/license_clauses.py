"""Clauses of license texts and notices, written by hand: label, priority, wording.

Wordings are in the notation of :mod:`.licenses`: ``a/b`` is either word, ``a?`` may lack,
``#`` is a number. A clause found in many licenses has the label of its kind.
"""

CLAUSES = """
mit | 62 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit | 62 | publish distribute sublicense and or sell copies of the software
mit | 58 | to permit persons to whom the software is furnished to do so subject to the following conditions
mit | 58 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 58 | this permission notice including the next paragraph shall be included in all copies
mit-0 | 63 | to permit persons to whom the software is furnished to do so the software is provided as is
isc | 61 | with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | 58 | the author disclaims all warranties with regard to this software
isc | 58 | in no event shall the author be liable for any special direct indirect or consequential damages
0bsd | 62 | for any purpose with or without fee is hereby granted the software is provided as is
bsd | 58 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 58 | redistributions in binary form must reproduce the above copyright notice
bsd | 57 | in the documentation and or other materials provided with the distribution
bsd | 57 | with or without modification are permitted provided that the following conditions are met
bsd-3-clause | 61 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 61 | neither the name of the nor the names of its contributors may be used
bsd-4-clause | 64 | all advertising materials mentioning features or use of this software must display the following acknowledgement/acknowledgment
bsd-2-clause | 55 | the views and conclusions contained in the software and documentation are those of the authors
bsd | 55 | this software is provided by the copyright holders and contributors as is
bsd | 55 | this software is provided by the regents and contributors as is
bsd | 55 | procurement of substitute goods or services loss of use data or profits or business interruption
bsd | 55 | in no event shall the copyright holder/owner or contributors be liable
bsd | 55 | arising in any way out of the use of this software even if advised of the possibility of such damage
apache-2.0 | 62 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 62 | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | 60 | you may obtain a copy of the license at
apache-2.0 | 61 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | 61 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license
apache-2.0 | 60 | licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license
apache-2.0 | 60 | you must give any other recipients of the work or derivative works a copy of this license
apache-2.0 | 60 | you must cause any modified files to carry prominent notices stating that you changed the files
apache-2.0 | 60 | if the work includes a notice text file as part of its distribution
apache-2.0 | 59 | unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work
apache-2.0 | 59 | this license does not grant permission to use the trade names trademarks service marks or product names of the licensor
apache-2.0 | 59 | while redistributing the work or derivative works thereof you may choose to offer
apache-1.1 | 63 | this product includes software developed by the apache software foundation
apache-1.1 | 60 | products derived from this software may not be called apache nor may apache appear in their name
gpl | 58 | this program is free software you can redistribute it and or modify it
gpl | 58 | this program is distributed in the hope that it will be useful but without any warranty
gpl | 57 | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | 57 | you should have received a copy of the gnu general public license along with this program
gpl | 57 | free software foundation inc 51 franklin street/st fifth floor boston ma
gpl | 57 | free software foundation inc 59 temple place suite 330 boston ma
gpl | 57 | free software foundation inc 675 mass ave cambridge ma
gpl | 56 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | 56 | when we speak of free software we are referring to freedom not price
gpl-2+ | 66 | either version 2 of the license or at your option any later version
gpl-3+ | 66 | either version 3 of the license or at your option any later version
gpl-1+ | 66 | either version 1 of the license or at your option any later version
gpl-2 | 62 | under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3 | 62 | under the terms of the gnu general public license version 3 as published by the free software foundation
gpl-2 | 58 | you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
gpl-2 | 58 | you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl-2 | 58 | if the modified program normally reads commands interactively when run
gpl-2 | 58 | accompany it with the complete corresponding machine readable source code
gpl-2 | 58 | accompany it with a written offer valid for at least three years
gpl-2 | 57 | you are not required to accept this license since you have not signed it
gpl-3 | 58 | you may convey verbatim copies of the program s source code as you receive it in any medium
gpl-3 | 58 | you may convey a work based on the program or the modifications to produce it from the program
gpl-3 | 58 | to convey a work means any kind of propagation that enables other parties to make or receive copies
gpl-3 | 58 | the corresponding source for a work in object code form means all the source code needed to generate install
gpl-3 | 58 | no covered work shall be deemed part of an effective technological measure
gpl-3 | 58 | a user product is either a consumer product which means any tangible personal property
gpl-3 | 58 | installation information for a user product means any methods procedures authorization keys
gpl-3 | 57 | each contributor grants you a non exclusive worldwide royalty free patent license under the contributor s essential patent claims
gpl-3 | 57 | if you convey a covered work knowingly relying on a patent license
gpl-3 | 57 | protecting users legal rights from anti circumvention law
classpath-exception | 67 | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gcc-exception | 67 | gcc runtime library exception
bison-exception | 67 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
autoconf-exception | 67 | configuration script generated by autoconf you may include it under the same distribution terms
font-exception | 67 | if you create a document which uses this font and embed this font
openssl-exception | 67 | permission to link the code of portions of this program with the openssl library
lgpl | 61 | this library is free software you can redistribute it and or modify it
lgpl | 60 | you should have received a copy of the gnu lesser/library general public license along with this library
lgpl-2.1+ | 67 | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-2+ | 67 | under the terms of the gnu library general public license as published by the free software foundation either version 2
lgpl-3+ | 67 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.1 | 59 | a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl-2.1 | 59 | the terms of the license permit modification of the work for the customer s own use and reverse engineering
lgpl-3 | 59 | an application is any work that makes use of an interface provided by the library
lgpl-3 | 59 | the combined work is a work produced by combining or linking an application with the library
agpl-3 | 63 | you must prominently offer all users interacting with it remotely through a computer network
agpl-3 | 62 | remote network interaction use with the gnu general public license
agpl-3+ | 67 | under the terms of the gnu affero general public license as published by the free software foundation either version 3
gfdl | 62 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 62 | with no invariant sections no front cover texts and no back cover texts
gfdl | 59 | a secondary section is a named appendix or a front matter section of the document
mpl-2.0 | 62 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | 61 | this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-2.0 | 58 | covered software means source code form to which the initial contributor has attached the notice
mpl-2.0 | 58 | all distribution of covered software in source code form including any modifications that you create
mpl-1.1 | 62 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | 58 | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license
mpl-1.1 | 58 | the initial developer of the original code is
mpl-1.1 | 58 | alternatively the contents of this file may be used under the terms of either the gnu general public license
npl-1.1 | 62 | the contents of this file are subject to the netscape public license
epl-1.0 | 60 | accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | 60 | accompanying materials are made available under the terms of the eclipse public license 2 0
epl | 58 | the accompanying program is provided under the terms of this eclipse public license agreement
epl | 57 | any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement
epl-2.0 | 60 | this source code may also be made available under the following secondary licenses when the conditions for such availability
edl-1.0 | 60 | eclipse distribution license v/version? 1 0
cpl | 57 | the accompanying program is provided under the terms of this common public license agreement
ipl-1.0 | 57 | the accompanying program is provided under the terms of this ibm public license agreement
cddl | 61 | the contents of this file are subject to the terms of the common development and distribution license
cddl | 60 | when distributing covered code include this cddl header in each file
cddl | 60 | you can obtain a copy of the license at usr src opensolaris license
eupl | 60 | licensed under the eupl version 1 1/2 or as soon they will be approved by the european commission
eupl | 58 | the licence s author is the european community the european commission may publish other linguistic versions
cecill | 60 | this software is governed by the cecill license under french law
cecill | 58 | abiding by the rules of distribution of free software you can use modify and or redistribute the software under the terms of the cecill
artistic | 60 | the intent of this document is to state the conditions under which a package may be copied
artistic | 58 | such that the copyright holder maintains some semblance of artistic control over the development of the package
artistic-2.0 | 60 | this license establishes the terms under which a given free software package may be copied modified distributed
perl | 62 | you can redistribute it and or modify it under the same terms as perl itself
ruby | 62 | you can redistribute it and or modify it under either the terms of the 2 clause bsdl
bsl-1.0 | 62 | to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software
bsl-1.0 | 62 | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
zlib | 62 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 62 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 62 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 58 | an acknowledgment/acknowledgement in the product documentation would be appreciated but is not required
libpng | 62 | the png reference library is supplied as is
ijg | 62 | this software is based in part on the work of the independent jpeg group
curl | 60 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
openssl | 62 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 62 | this product includes cryptographic software written by eric young
unlicense | 62 | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 61 | the author or authors of this software dedicate any and all copyright interest in the software to the public domain
unlicense | 61 | we make this dedication for the benefit of the public at large and to the detriment of our heirs
wtfpl | 62 | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
wtfpl | 62 | you just do what the fuck you want to
beerware | 62 | as long as you retain this notice you can do whatever you want with this stuff
beerware | 62 | if we meet some day and you think this stuff is worth it you can buy me a beer
json | 62 | the software shall be used for good not evil
x11 | 62 | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
hpnd | 59 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | 58 | not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
ntp | 59 | makes no representations about the suitability this software for any purpose it is provided as is
ofl-1.1 | 62 | this font software is licensed under the sil open font license
ofl-1.1 | 61 | neither the font software nor any of its individual components in original or modified versions may be sold by itself
ofl-1.1 | 61 | no modified version of the font software may use the reserved font name
psf-2.0 | 61 | psf is making python available to licensee on an as is basis
psf-2.0 | 61 | this license agreement is between the python software foundation and the individual or organization
php-3.01 | 61 | this product includes php software freely available from
postgresql | 61 | without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
postgresql | 59 | the university of california specifically disclaims any warranties
ncsa | 61 | to deal with the software without restriction including without limitation the rights to use copy modify merge
ms-pl | 61 | if you bring a patent claim against any contributor over patents that you claim are infringed by the software
ms-rl | 62 | for any file you distribute that contains code from the software you must provide recipients the source code to that file
cc-by | 61 | you are free to share copy and redistribute the material in any medium or format
cc-by | 61 | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by | 58 | you may do so in any reasonable manner but not in any way that suggests the licensor endorses you or your use
cc-by-sa | 63 | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc | 63 | you may not use the material for commercial purposes
cc-by-nd | 63 | if you remix transform or build upon the material you may not distribute the modified material
creative-commons | 58 | you may not apply legal terms or technological measures that legally restrict others from doing anything the license permits
creative-commons | 58 | this work is licensed under a creative commons
creative-commons | 57 | the work as defined below is provided under the terms of this creative commons public license
creative-commons | 57 | by exercising any rights to the work provided here you accept and agree to be bound by the terms of this license
creative-commons | 57 | by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this
cc0 | 62 | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | 62 | to the extent possible under law has waived all copyright and related or neighboring rights
cc0 | 62 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
pdm | 60 | this work has been identified as being free of known restrictions under copyright law
public-domain | 57 | this work is in the public domain in/because/and
public-domain | 57 | this software is in the public domain
public-domain | 57 | the author hereby disclaims copyright to this source code
public-domain | 57 | placed in the public domain
public-domain | 57 | not subject to copyright protection and is in the public domain
public-domain | 57 | pursuant to title 17 section 105 of the united states code this software is not subject to copyright protection
odbl | 61 | this database is made available under the open database license
odbl | 60 | any rights in individual contents of the database are licensed under the database contents license
ogl-uk | 61 | contains public sector information licensed under the open government licence
ogl-canada | 61 | contains information licensed under the open government licence canada
etalab-2.0 | 61 | licence ouverte open licence
dl-de-by | 61 | datenlizenz deutschland namensnennung version 2 0
dl-de-zero | 61 | datenlizenz deutschland zero version 2 0
gutenberg | 62 | this ebook is for the use of anyone anywhere in the united states and most other parts of the world at no cost
gutenberg | 62 | you may copy it give it away or re use it under the terms of the project gutenberg license
wikipedia | 61 | text is available under the creative commons attribution sharealike license additional terms may apply
openrail | 62 | you agree not to use the model or derivatives of the model in any way that violates any applicable
openrail | 61 | use based restrictions as referenced in paragraph 5
llama | 62 | llama 2/3 is licensed under the llama 2/3 community license
llama | 61 | if the monthly active users of the products or services made available by or for licensee
gemma | 62 | gemma is provided under and subject to the gemma terms of use
busl-1.1 | 62 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl-1.1 | 61 | change date four years from the date the licensed work is published
sspl-1.0 | 62 | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | 62 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 63 | the license does not grant to you the right to sell the software
polyform | 61 | polyform noncommercial/strict/shield/internal license
fair-source | 61 | functional source license version 1
hippocratic | 61 | the software shall not be used by any person or entity for any systems activities or other uses that violate any human rights
no-commercial-use | 45 | for non commercial use/purposes only
no-commercial-use | 45 | not for commercial use
no-commercial-use | 45 | for personal use only
no-commercial-use | 45 | for educational/academic/research purposes/use only
no-redistribution | 46 | may not be reproduced distributed transmitted displayed published or broadcast
no-redistribution | 46 | this material may not be published broadcast rewritten or redistributed
no-redistribution | 46 | no part of this publication/book/work/document may be reproduced
no-redistribution | 45 | unauthorized/unauthorised copying distribution/reproduction/use
no-redistribution | 45 | without the prior/express written/permission consent/permission of the publisher/author/copyright
no-redistribution | 45 | reproduction in whole or in part without permission is prohibited
no-redistribution | 45 | do not redistribute
terms-of-use | 44 | by accessing or using this site/website/service you agree to be bound by these terms
terms-of-use | 44 | these terms and conditions govern your use of this website/site
terms-of-use | 44 | subject to the terms of use and privacy policy
terms-of-use | 44 | end user license/licence agreement
terms-of-use | 44 | you may not reverse engineer decompile or disassemble
proprietary | 46 | this software is the confidential and proprietary information of
proprietary | 46 | contains trade secrets and confidential information
proprietary | 46 | is proprietary to and may not be used copied or disclosed
proprietary | 45 | restricted rights legend use duplication or disclosure by the government is subject to restrictions
proprietary | 45 | commercial computer software as defined in far
press | 47 | the associated press all rights reserved
press | 47 | copyright # reuters limited
press | 47 | this article was originally published on the conversation read the original article
press | 46 | republished with permission of
press | 46 | reprinted with permission from
no-warranty | 40 | the software is provided as is without warranty of any kind express or implied
no-warranty | 40 | including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
no-warranty | 40 | the implied warranties of merchantability and fitness for a particular purpose are disclaimed
no-warranty | 40 | there is no warranty for the program to the extent permitted by applicable law
no-warranty | 40 | this software is provided as is with no warranties
no-warranty | 39 | provided as is with all faults
no-warranty | 39 | use at your own risk no warranty
no-liability | 40 | in no event shall the authors or copyright holders be liable for any claim damages or other liability
no-liability | 40 | whether in an action of contract tort or otherwise arising from out of or in connection with the software
no-liability | 40 | in no event unless required by applicable law or agreed to in writing will any copyright holder
no-liability | 40 | be liable for any direct indirect incidental special exemplary or consequential damages
no-liability | 39 | to the maximum extent permitted by applicable law in no event shall
patent-grant | 41 | hereby grants you a perpetual worldwide royalty free patent license
patent-grant | 41 | additional grant of patent rights
trademark | 38 | is a registered trademark of
trademark | 38 | are registered trademarks of
trademark | 37 | all trademarks are the property of their respective owners
dual | 48 | is dual licensed under
dual | 48 | licensed under either of apache license version 2 0 or mit license at your option
dual | 48 | at your option under the terms of either
see-license | 35 | see the license/licence/copying file for details
see-license | 35 | see license/licence txt/md
see-license | 35 | license/licence information can be found in
see-license | 35 | for license/licence terms see
copyright | 36 | portions copyright c? #
copyright | 36 | copyright # the authors/author
copyright | 36 | copyright holder/owner/owners/holders
copyright | 36 | this work is protected by copyright
copyright | 36 | this content is copyrighted
copyright | 36 | the authors/author retain/retains copyright
copyright | 36 | copyright remains with the author/authors
open-access | 42 | this is an open access article distributed under the terms of the
open-access | 42 | open access publication under the
open-access | 42 | this article is published with open access
"""


def clauses() -> list[tuple[str, str, int]]:
    """``label, wording, priority`` of every clause."""
    return [(label, words, int(priority)) for label, priority, words in (line.split(" | ") for line in CLAUSES.strip().splitlines())]
