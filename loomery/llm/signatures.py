"""The license scan's hand-written signatures: sentences of license bodies, notices and headers, bare names, and glued forms.

A signature is a label and a phrase, as words; the word between asterisks is its anchor, the rest may be a regular expression.
"""

from __future__ import annotations

#: Sentences of license texts and their usual headers, (label, phrase).
BODIES = (
    ("mit", "permission is *hereby* granted free of charge to any person obtaining a copy of this software"),
    ("mit", "all copies or *substantial* portions of the software"),
    ("mit", "to use copy modify merge publish distribute *sublicense* and or sell copies of the software"),
    ("mit", "in no event shall the authors or copyright holders be *liable* for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit-0", "to deal in the software without *restriction* including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is *hereby* granted"),
    ("0bsd", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby *granted* the software is provided"),
    ("isc", "provided that the above copyright notice and this permission notice *appear* in all copies"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is *hereby* granted"),
    ("bsd", "*redistribution* and use in source and binary forms with or without modification (?:are|is) permitted"),
    ("bsd", "*redistributions* of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "*redistributions* in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "nor the names of (?:its|their|the|any)(?: [^ ]+)? *contributors* may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "may not be used to *endorse* or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all *advertising* materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s *patent* rights are granted by this license"),
    ("zlib", "this software is provided as is without any express or implied *warranty* in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be *misrepresented* you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be *plainly* marked as such"),
    ("libpng", "this *notice* may not be removed or altered from any source (?:or altered source )?distribution"),
    ("boost", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute *execute* and transmit the software"),
    ("boost", "unless such copies or derivative works are solely in the form of *machine* executable object code generated by a source language processor"),
    ("apache-2.0", "licensed under the *apache* license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "you may not use this file except in *compliance* with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is *basis* without warranties or conditions of any kind"),
    ("apache-2.0", "*perpetual* worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("apache-1.1", "this product includes software developed by the *apache* software foundation"),
    ("gpl", "is free software you can *redistribute* it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the *gnu* general public license along with"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the *gnu* general public license for more details"),
    ("gpl", "everyone is permitted to copy and distribute *verbatim* copies of this license document but changing it is not allowed"),
    ("gpl-2.0", "either version 2 of the license or at your *option* any later version"),
    ("gpl-3.0", "either version 3 of the license or at your *option* any later version"),
    ("gpl-2.0", "gnu general public license *version* 2 june 1991"),
    ("gpl-3.0", "gnu general public license *version* 3 29 june 2007"),
    ("gpl", "the licenses for most software are designed to take away your *freedom* to share and change it"),
    ("lgpl", "under the terms of the gnu *lesser* general public license"),
    ("lgpl", "under the terms of the gnu *library* general public license"),
    ("lgpl-2.1", "either version 2 1 of the license or at your *option* any later version"),
    ("lgpl-2.1", "gnu *lesser* general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu *lesser* general public license version 3 29 june 2007"),
    ("agpl", "under the terms of the gnu *affero* general public license"),
    ("agpl-3.0", "gnu *affero* general public license version 3 19 november 2007"),
    ("agpl", "your modified version must prominently offer all users interacting with it *remotely* through a computer network"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free *documentation* license"),
    ("gfdl", "with no *invariant* sections no front cover texts and no back cover texts"),
    ("linking-exception", "as a special *exception* the copyright holders (?:of this library )?give you permission to link"),
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a *combined* work based on this library"),
    ("mpl-2.0", "this source code form is *subject* to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the *mpl* was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "the contents of this file are *subject* to the mozilla public license version 1 1"),
    ("epl", "this program and the accompanying materials are made available under the terms of the *eclipse* public license"),
    ("epl", "the accompanying program is provided under the terms of this *eclipse* public license agreement"),
    ("cddl", "the contents of this file are subject to the terms of the common *development* and distribution license"),
    ("eupl", "licensed under the *eupl*(?: version)?(?: [0-9]+)*"),
    ("ms-pl", "this license governs use of the *accompanying* software if you use the software you accept this license"),
    ("ms-rl", "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license which license will govern that file you may license other files that are entirely your own work and do not contain code from the software under any terms you choose *reciprocal* grants"),
    ("artistic", "the intent of this document is to state the conditions under which a *package* may be copied"),
    ("artistic-2.0", "this license establishes the terms under which a given free software *package* may be copied modified distributed and or redistributed"),
    ("psf", "this license agreement is between the *python* software foundation"),
    ("psf", "*psf* hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "products derived from this software may not be called *php* nor may php appear in their name"),
    ("openssl", "this product includes software developed by the *openssl* project for use in the openssl toolkit"),
    ("ssleay", "this product includes *cryptographic* software written by eric young"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and *noninfringement* of third party rights"),
    ("ncsa", "to deal with the software without *restriction* including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("icu", "except as contained in this notice the name of a copyright holder shall not be used in *advertising* or otherwise to promote the sale use or other dealings in this software"),
    ("unicode", "to any person obtaining a copy of the *unicode* data files and any associated documentation"),
    ("w3c", "by obtaining using and or copying this work you the *licensee* agree that you have read understood and will comply"),
    ("postgresql", "in no event shall the *university* of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ofl", "the goals of the open *font* license are to stimulate worldwide development of collaborative font projects"),
    ("ofl", "this *font* software is licensed under the sil open font license"),
    ("lppl", "this work may be distributed and or modified under the conditions of the *latex* project public license"),
    ("cecill", "this software is governed by the *cecill*(?: b| c)? license under french law"),
    ("upl", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data collectively the *software* free of charge"),
    ("wtfpl", "you just do what the *fuck* you want to"),
    ("wtfpl", "everyone is permitted to copy and distribute *verbatim* or modified copies of this license document and changing it is allowed"),
    ("unlicense", "this is free and *unencumbered* software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a *compiled* binary"),
    ("cc0", "to the extent possible under law (?:[^ ]+ ){1,6}has *waived* all copyright and related or neighboring rights"),
    ("cc0", "the person who associated a work with this *deed* has dedicated the work to the public domain"),
    ("cc-by", "this work is licensed under a *creative* commons attribution (?:[0-9]+ )*(?:international|unported|generic)(?: [0-9]+)* license"),
    ("cc-by-sa", "if you *remix* transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by", "you must give *appropriate* credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "you may not use the material for *commercial* purposes"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a *beer* in return"),
    ("json", "the software shall be used for good not *evil*"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the *db* software"),
    ("vim", "there are no *restrictions* on distributing unmodified copies of vim except that they must include this license text"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without *restriction* provided that you duplicate all of the original copyright notices"),
    ("x11", "except as contained in this notice the name of the x *consortium* shall not be used in advertising"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in *supporting* documentation"),
    ("elastic", "you may not provide the software to third parties as a hosted or *managed* service"),
    ("busl", "the *licensor* hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a *service*"),
    ("commons-clause", "the license does not grant to you the right to *sell* the software"),
    ("public-domain", "this (?:work|file|software|code) is (?:hereby )?(?:placed )?in the public *domain*"),
    ("public-domain", "the author (?:hereby )?*disclaims* copyright to this source code"),
    ("proprietary", "no part of this (?:publication|work|book|document) may be *reproduced*"),
    ("proprietary", "*unauthorized* (?:copying|reproduction|distribution|use)(?: or (?:copying|reproduction|distribution|use))? of this (?:file|software|work|document)"),
    ("proprietary", "this software is the *confidential* and proprietary information of"),
    ("proprietary", "for *internal* use only"),
    ("warranty", "the software is provided as is without *warranty* of any kind"),
    ("warranty", "without even the implied warranty of *merchantability* or fitness for a particular purpose"),
    ("warranty", "this software is provided by the copyright holders and contributors as is and any express or implied *warranties*"),
    ("warranty", "in no event shall the copyright (?:holder|owner|holders)(?: or contributors)? be *liable* for any direct indirect incidental special exemplary or consequential damages"),
)
#: Names that carry their version in one word, (label, anchor).
GLUED = (
    ("gpl-1.0", "gplv1"), ("gpl-2.0", "gplv2"), ("gpl-2.0", "gpl2"), ("gpl-3.0", "gplv3"), ("gpl-3.0", "gpl3"), ("lgpl-2.1", "lgplv2"), ("lgpl-2.1", "lgpl2"), ("lgpl-3.0", "lgplv3"), ("lgpl-3.0", "lgpl3"),
    ("agpl-3.0", "agplv3"), ("agpl-3.0", "agpl3"), ("apache-2.0", "apache2"), ("apache-2.0", "aslv2"), ("mpl-1.1", "mplv1"), ("mpl-2.0", "mplv2"), ("mpl-2.0", "mpl2"), ("epl-1.0", "eplv1"), ("epl-2.0", "eplv2"),
    ("bsd-2-clause", "bsd2"), ("bsd-3-clause", "bsd3"), ("bsd-2-clause", "bsd2clause"), ("bsd-3-clause", "bsd3clause"), ("artistic-2.0", "artistic2"), ("0bsd", "0bsd"), ("mit-0", "mit0"), ("cddl-1.0", "cddlv1"), ("gfdl", "gfdlv1"),
)
