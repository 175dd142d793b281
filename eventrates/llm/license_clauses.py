"""Signatures of licence clauses, as words of the licences' own texts.

One line per clause: the words, lower-cased and without marks, ``>`` before the anchor. Where a clause stands word for
word in several licences, its label names the family or only the kind of clause.
"""

from __future__ import annotations

# Clauses that grant rights.
GRANTS = {
    "MIT": [
        "permission is >hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute >sublicense and or sell copies of the software",
        "permit persons to whom the software is >furnished to do so",
    ],
    "X11": [
        "shall not be used in >advertising or otherwise to promote the sale use or other dealings in this software",
    ],
    "ISC": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is >hereby granted",
        "permission to use copy modify and distribute this software for any purpose with or without fee is >hereby granted",
    ],
    "HPND": [
        "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is >hereby granted",
        "permission to use copy modify distribute and sell this software and its documentation for any purpose is >hereby granted without fee",
    ],
    "NTP": [
        "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is >hereby granted",
    ],
    "BSD": [
        "redistribution and use in source and binary forms with or without modification are >permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are >permitted",
    ],
    "BSD-3-Clause-Clear": [
        "are >permitted subject to the limitations in the disclaimer below provided that the following conditions are met",
        "no express or implied >licenses to any party s patent rights are granted by this license",
    ],
    "NCSA": [
        "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute >sublicense and or sell",
    ],
    "Zlib": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and >redistribute it freely",
    ],
    "BSL-1.0": [
        "permission is >hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "to use reproduce display distribute execute and transmit the software and to prepare >derivative works of the software",
    ],
    "Apache-2.0": [
        "each contributor >hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of",
        "each contributor >hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license",
        "where such license applies only to those patent claims licensable by such >contributor that are necessarily infringed by their contribution",
        "you may obtain a copy of the license at http www apache org >licenses license 2 0",
    ],
    "GPL": [
        "is free software you can >redistribute it and or modify it under the terms of the gnu general public license",
        "you may copy and distribute >verbatim copies of the program s source code as you receive it in any medium",
        "you may convey >verbatim copies of the program s source code as you receive it in any medium",
    ],
    "GPL-2.0": [
        "you may copy and distribute the program or a work based on it under section 2 in object code or >executable form under the terms of sections 1 and 2",
    ],
    "GPL-3.0": [
        "all rights granted under this >license are granted for the term of copyright on the program and are irrevocable provided the stated conditions are met",
        "you may make run and propagate covered works that you do not convey without conditions so long as your >license otherwise remains in force",
    ],
    "LGPL": [
        "is free software you can >redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
        "you may copy and distribute >verbatim copies of the library s complete source code as you receive it",
    ],
    "AGPL-3.0": [
        "is free software you can >redistribute it and or modify it under the terms of the gnu affero general public license",
    ],
    "GFDL": [
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation >license",
        "you may copy and distribute the document in any medium either commercially or noncommercially provided that this >license",
    ],
    "MPL-1.1": [
        "the initial developer >hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property claims",
        "each contributor >hereby grants you a world wide royalty free non exclusive license",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the >mozilla public license",
        "each contributor >hereby grants you a world wide royalty free non exclusive license under intellectual property rights other than patent or trademark licensable by such contributor",
        "under patent claims of such >contributor to make use sell offer for sale have made import and otherwise transfer either its contributions or its contributor version",
    ],
    "EPL": [
        "each contributor >hereby grants recipient a non exclusive worldwide royalty free copyright license to reproduce prepare derivative works of publicly display",
        "each contributor >hereby grants recipient a non exclusive worldwide royalty free patent license under licensed patents",
    ],
    "EUPL": [
        "the >licensor hereby grants you a world wide royalty free non exclusive sub ?licensable licen[cs]e to do the following",
        "the >licensor grants to you royalty free non exclusive usage rights to any patents held by the licensor",
    ],
    "CDDL": [
        "the initial developer >hereby grants you a world wide royalty free non exclusive license under intellectual property rights other than patent or trademark licensable by initial developer",
    ],
    "OFL-1.1": [
        "permission is >hereby granted free of charge to any person obtaining a copy of the font software",
        "to use study copy merge embed modify >redistribute and sell modified and unmodified copies of the font software",
    ],
    "Artistic-1.0": [
        "you may make and give away >verbatim copies of the source form of the standard version of this package without restriction",
        "you may otherwise modify your copy of this package in any way provided that you insert a >prominent notice in each changed file",
    ],
    "Artistic-2.0": [
        "you are >permitted to use the standard version and create and use modified versions for any purpose without restriction",
        "you may distribute >verbatim copies of the source form of the standard version of this package in any medium without restriction",
    ],
    "Unlicense": [
        "this is free and >unencumbered software released into the public domain",
        "publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose >commercial or non commercial and by any means",
        "the author or authors of this software dedicate any and all >copyright interest in the software to the public domain",
        "we make this >dedication for the benefit of the public at large and to the detriment of our heirs and successors",
        "an overt act of relinquishment in perpetuity of all present and future rights to this software under >copyright law",
    ],
    "CC0-1.0": [
        "affirmer >hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights",
        "the person who associated a work with this deed has >dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        "to the extent possible under law (?:[^ >]+ ){1,12}has waived all >copyright and related or neighboring rights to",
        "you can copy modify distribute and perform the work even for commercial purposes all without asking >permission",
    ],
    "PDDL-1.0": [
        "the rightsholder >hereby dedicates to the public domain all copyright and database rights",
        "the >rightsholder by using this document dedicates the work to the public domain for the benefit of the public and relinquishes all rights in copyright",
    ],
    "WTFPL": [
        "everyone is permitted to copy and distribute >verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    ],
    "Beerware": [
        "as long as you >retain this notice you can do whatever you want with this stuff",
    ],
    "PostgreSQL": [
        "and its documentation for any purpose without fee and without a written agreement is >hereby granted",
    ],
    "PSF-2.0": [
        "psf >hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly",
        "psf is making python available to >licensee on an as is basis",
    ],
    "Ruby": [
        "you may make and give away >verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices",
    ],
    "Vim": [
        "there are no restrictions on distributing unmodified copies of vim except that they must include this >license text",
    ],
    "AFL-3.0": [
        ">licensed under the academic free license version 3 0",
        ">licensor grants you a worldwide royalty free non exclusive sublicensable license for the duration of the copyright",
    ],
    "MS-PL": [
        "each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution prepare >derivative works of its contribution",
        "each contributor grants you a non exclusive worldwide royalty free license under its >licensed patents to make have made use sell offer for sale import",
    ],
    "BUSL-1.1": [
        "the licensor >hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",
        "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the >licensed work",
    ],
    "Elastic-2.0": [
        "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable >license to use copy distribute make available and prepare derivative works of the software",
    ],
    "ODbL-1.0": [
        "the >licensor grants to you a worldwide royalty free non exclusive terminable but only under section 9 license to use the database",
        "you are free to copy distribute transmit and adapt our data as long as you >credit",
    ],
    "CC-BY": [
        "you are free to share copy and >redistribute the material in any medium or format(?: and)? adapt remix transform and build upon the material for any purpose even commercially",
    ],
    "CC": [
        "the licensor >hereby grants you a worldwide royalty free non sublicensable non exclusive irrevocable license to exercise the licensed rights in the licensed material",
        "licensor hereby grants you a worldwide royalty free non exclusive perpetual for the duration of the applicable copyright >license to exercise the rights in the work",
    ],
    "LPPL-1.3": [
        "this work may be distributed and or modified under the conditions of the latex project public >license",
    ],
    "OpenRAIL": [
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright >license to reproduce prepare publicly display publicly perform sublicense and distribute the complementary material",
    ],
    "UPL-1.0": [
        "permission is >hereby granted free of charge subject to the following condition to any person obtaining a copy of this software associated documentation and or data",
    ],
    "Unicode": [
        "permission is >hereby granted free of charge to any person obtaining a copy of(?: the unicode)? data files and any associated documentation",
    ],
    "ICU": [
        "and to permit persons to whom the software is >furnished to do so provided that the above copyright notice",
    ],
    "libpng": [
        "permission is >hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee",
    ],
    "IJG": [
        "permission is >hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee",
    ],
    "SunPro": [
        ">permission to use copy modify and distribute this software is freely granted provided that this notice is preserved",
    ],
}

# Clauses that set conditions.
CONDITIONS = {
    "MIT": [
        "the above >copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "ISC": ["provided that the above >copyright notice and this permission notice appear in all copies"],
    "HPND": [
        "provided that the above copyright notice appear in all copies and that both that copyright notice and this >permission notice appear in supporting documentation",
        "not be used in advertising or publicity pertaining to distribution of the software without specific written prior >permission",
    ],
    "BSD": [
        "redistributions of source code must retain the above >copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above >copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "BSD-3-Clause": [
        "neither the names? of (?:[^ >]+ ){1,12}nor the names of (?:its|the|any) >contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the names? of (?:[^ >]+ ){1,12}may not be used to >endorse or promote products derived from this software without specific prior written permission",
    ],
    "BSD-4-Clause": [
        "all >advertising materials mentioning features or use of this software must display the following acknowledge?ment",
        "this product includes software developed by the university of california(?: berkeley)? and its >contributors",
    ],
    "OpenSSL": [
        "this product includes software developed by the >openssl project for use in the openssl toolkit",
        "must not be used to >endorse or promote products derived from this software without prior written permission for written permission please contact openssl",
        "this package is an >ssl implementation written by eric young",
    ],
    "Apache-1.1": [
        "this product includes software developed by the >apache software foundation",
        "products derived from this software may not be called apache nor may apache appear in their name without prior written >permission of the apache software foundation",
    ],
    "NCSA": [
        "redistributions of source code must retain the above >copyright notice this list of conditions and the following disclaimers",
    ],
    "Zlib": [
        "the origin of this software must not be >misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be >misrepresented as being the original software",
        "an (?:>acknowledgement|>acknowledgment) in the product documentation would be appreciated but is not required",
        "this notice may not be removed or altered from any source >distribution",
    ],
    "BSL-1.0": [
        "must be included in all copies of the software in whole or in part and all >derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the >license",
        "you must give any other recipients of the work or >derivative works a copy of this license",
        "you must cause any >modified files to carry prominent notices stating that you changed the files",
        "if the work includes a notice text file as part of its distribution then any >derivative works that you distribute must include a readable copy",
        "unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work by you to the >licensor shall be under the terms and conditions of this license",
        "if you institute patent >litigation against any entity including a cross claim or counterclaim in a lawsuit",
        "this license does not grant permission to use the trade names trademarks service marks or product names of the >licensor",
        "you may act only on your own behalf and on your sole responsibility not on behalf of any other >contributor and only if you agree to indemnify",
    ],
    "GPL": [
        "you are not required to accept this >license in order to receive or run a copy of the program",
        "you are not required to accept this >license since you have not signed it",
        "the source code for a work means the preferred form of the work for making >modifications to it",
        "each time you redistribute the program or any work based on the program the recipient automatically receives a license from the original >licensor",
        "you should have received a copy of the gnu general public >license along with this program",
    ],
    "GPL-2.0": [
        "contains or is derived from the program or any part thereof to be >licensed as a whole at no charge to all third parties",
        "accompany it with the complete corresponding machine readable source code which must be >distributed under the terms of sections 1 and 2 above",
        "you must cause the >modified files to carry prominent notices stating that you changed the files and the date of any change",
        "you may not copy modify >sublicense or distribute the program except as expressly provided under this license",
        "if distribution of >executable or object code is made by offering access to copy from a designated place",
    ],
    "GPL-3.0": [
        "the gnu general public license is a free >copyleft license for software and other kinds of works",
        "no covered work shall be deemed part of an effective >technological measure under any applicable law",
        "the work must carry prominent notices stating that you >modified it and giving a relevant date",
        "you must license the entire work as a whole under this license to anyone who comes into >possession of a copy",
        "the corresponding source for a work in object code form means all the source code needed to generate install and for an >executable work run the object code",
        "you may not propagate or modify a covered work except as expressly provided under this >license",
        "an entity >transaction is a transaction transferring control of an organization or substantially all assets of one",
        "installation information for a user product means any methods procedures authorization keys or other information required to install and execute >modified versions",
    ],
    "LGPL": [
        "a program that contains no >derivative of any portion of the library but is designed to work with the library by being compiled or linked with it",
        "you should have received a copy of the gnu (?:lesser|library) general public >license along with this library",
        "the >modified work must itself be a software library",
        "a >combined work is a work produced by combining or linking an application with the library",
    ],
    "AGPL-3.0": [
        "if you modify the program your >modified version must prominently offer all users interacting with it remotely through a computer network",
        "you should have received a copy of the gnu affero general public >license along with this program",
    ],
    "GFDL": [
        "with no >invariant sections no front cover texts and no back cover texts",
        "a >transparent copy of the document means a machine readable copy represented in a format whose specification is available to the general public",
        "if you publish printed copies of the document numbering more than 100 and the document s >license notice requires cover texts",
    ],
    "MPL-1.1": [
        "the contents of this file are subject to the >mozilla public license version 1 1 the license you may not use this file except in compliance with the license",
        "the >modifications which you create or to which you contribute are governed by the terms of this license",
        "the initial >developer of the original code is",
    ],
    "MPL-2.0": [
        "if a copy of the mpl was not >distributed with this file you can obtain one at",
        "this source code form is incompatible with secondary >licenses as defined by the mozilla public license",
        "all distribution of covered software in source code form including any >modifications that you create or to which you contribute must be under the terms of this license",
        "you may not remove or alter the substance of any >license notices",
    ],
    "EPL": [
        "this program and the accompanying materials are made available under the terms of the eclipse public >license",
        "a >contributor may choose to distribute the program in object code form under its own license agreement",
        "commercial >distributors of software may accept certain responsibilities with respect to end users business partners and the like",
    ],
    "EPL-2.0": [
        "this source code may also be made available under the following secondary >licenses when the conditions for such availability set forth in the eclipse public license v 2 0 are satisfied",
    ],
    "EUPL": [
        "if the licensee distributes and or communicates copies of the original works or >derivative works based upon the original work this distribution and or communication will be done under the terms of this licence",
        ">licensed under the eupl version 1 [12] or as soon they will be approved by the european commission subsequent versions of the eupl",
    ],
    "CDDL": [
        "any covered software that you distribute or otherwise make available in >executable form must also be made available in source code form",
        "you can obtain a copy of the license at usr src opensolaris license or http www opensolaris org os >licensing",
        "when distributing covered code include this cddl header in each file and include the >license file",
    ],
    "OFL-1.1": [
        "neither the font software nor any of its individual components in original or >modified versions may be sold by itself",
        "no >modified version of the font software may use the reserved font name s unless explicit written permission is granted",
        "the font software modified or unmodified in part or in whole must be distributed entirely under this >license",
    ],
    "Artistic-1.0": [
        "you may not charge a fee for this package itself however you may distribute this package in >aggregate with other possibly commercial programs",
        "the scripts and library files supplied as input to or produced as output from the programs of this package do not >automatically fall under the copyright of this package",
    ],
    "Artistic-2.0": [
        "make the modified version available to the copyright holder of the standard version under the original >license so that the copyright holder may include your modifications in the standard version",
    ],
    "CC-BY": [
        "you must give appropriate credit provide a link to the >license and indicate if changes were made",
        "you must keep intact all >copyright notices for the work and provide reasonable to the medium or means you are utilizing the name of the original author",
        "retain the following if it is supplied by the licensor with the >licensed material identification of the creator",
    ],
    "CC-BY-SA": [
        "if you remix transform or build upon the material you must distribute your contributions under the same >license as the original",
        "the >adapter s license you apply must be a creative commons license with the same license elements this version or later",
        "you may distribute the resulting work only under the same(?: or similar| similar or a compatible)? >license",
    ],
    "CC-BY-NC": [
        "you may not use the material for >commercial purposes",
        "primarily intended for or directed toward >commercial advantage or (?:private )?monetary compensation",
    ],
    "CC-BY-ND": [
        "if you remix transform or build upon the material you may not distribute the >modified material",
        "you do not have permission under this public >license to share adapted material",
    ],
    "CC": [
        "you may not apply legal terms or technological measures that legally restrict others from doing anything the >license permits",
        "the >licensor cannot revoke these freedoms as long as you follow the license terms",
    ],
    "ODbL-1.0": [
        "if you publicly use any adapted version of this database or works produced from an adapted database you must also offer that >adapted database under the odbl",
        "which is made available here under the open >database license",
    ],
    "PSF-2.0": [
        "in the event licensee prepares a >derivative work that is based on or incorporates python or any part thereof",
        "nothing in this license agreement shall be deemed to create any relationship of agency partnership or joint venture between psf and >licensee",
    ],
    "PHP-3.01": [
        "products derived from this software may not be called php nor may php appear in their name without prior written >permission from group php net",
        "this product includes >php software freely available from",
    ],
    "SSPL-1.0": [
        "if you make the functionality of the program or a >modified version available to third parties as a service you must make the service source code available via network download",
    ],
    "Elastic-2.0": [
        "you may not provide the software to third parties as a hosted or >managed service where the service provides users with access to any substantial set of the features",
        "you may not move change disable or circumvent the >license key functionality in the software",
    ],
    "MS-PL": [
        "if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent >license from such contributor to the software ends automatically",
    ],
    "MS-RL": [
        "for any file you distribute that contains code from the software in source code or binary format you must provide >recipients the source code to that file along with a copy of this license",
    ],
    "Sleepycat": [
        ">redistributions in any form must be accompanied by information on how to obtain complete source code for the db software",
    ],
    "QPL-1.0": [
        "you may make >modifications to the software and distribute your modifications in a form that is separate from the software such as patches",
    ],
    "Vim": [
        "it is allowed to distribute a >modified or extended version of vim including executables and or source code when the following four conditions are met",
    ],
    "LPPL-1.3": [
        "this work has the >lppl maintenance status (?:author )?(?:un)?maintained",
    ],
    "JSON": ["the software shall be used for good not >evil"],
    "BUSL-1.1": [
        "the requirements currently in effect as described in this license you must purchase a commercial license from the >licensor",
    ],
    "Commons-Clause": [
        "the grant of rights under the >license will not include and the license does not grant to you the right to sell the software",
    ],
    "Llama": [
        "if you use the llama materials to create train fine tune or otherwise improve an ai model which is >distributed or made available you shall also include llama",
    ],
    "OpenRAIL": [
        "you agree not to use the model or >derivatives of the model in any way that violates any applicable national federal state local or international law or regulation",
    ],
    "IJG": [
        "this software is based in part on the work of the independent >jpeg group",
    ],
    "proprietary": [
        "unauthori[sz]ed copying of this file via any medium is strictly >prohibited",
        "this software is the >confidential and proprietary information of",
        "(?:publication|work|document|book) may be >reproduced(?: distributed)?(?: or)?(?: stored in a retrieval system)?(?: or)? transmitted in any form or by any means",
        "reproduction in whole or in part without(?: express)?(?: prior)?(?: written)? permission is(?: strictly)? >prohibited",
        "may not be reproduced distributed or transmitted in any form (?:or by any means )?without the prior written >permission",
        "this material may not be published broadcast rewritten or >redistributed",
        "you may not reverse engineer >decompile or disassemble the software",
    ],
}

# Disclaimers and definitions.
DISCLAIMERS = {
    "warranty-disclaimer": [
        "the software is provided as is without >warranty of any kind express or implied",
        "including but not limited to the >warranties of merchantability fitness for a particular purpose and non ?infringement",
        "in no event shall the authors or copyright holders be >liable for any claim damages or other liability",
        "without any warranty without even the implied warranty of >merchantability or fitness for a particular purpose",
        "distributed on an as is basis without >warranties or conditions of any kind either express or implied",
    ],
    "BSD": [
        "as is and any express or implied >warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "be >liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    ],
    "ISC": [
        "the software is provided as is and the author disclaims all >warranties with regard to this software",
        "be >liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ],
    "Zlib": [
        "this software is provided as is without any express or implied >warranty in no event will the authors be held liable for any damages arising from the use of this software",
    ],
    "BSL-1.0": [
        "be >liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software",
    ],
    "Apache-2.0": [
        "agreed to in writing (?:software distributed under the license is distributed|licensor provides the work and each contributor provides its contributions) on an as is basis without >warranties or conditions of any kind",
        ">licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
        ">derivative works shall mean any work whether in source or object form that is based on or derived from the work",
        "contribution shall mean any work of authorship including the original version of the work and any >modifications or additions to that work",
    ],
    "GPL": [
        "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of >merchantability or fitness for a particular purpose see the gnu general public license",
        "there is no >warranty for the program to the extent permitted by applicable law",
        "this is free software and you are welcome to >redistribute it under certain conditions",
        "the >licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change",
        "everyone is permitted to copy and distribute >verbatim copies of this license document but changing it is not allowed",
    ],
    "LGPL": [
        "but without any warranty without even the implied warranty of >merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license",
    ],
    "AGPL-3.0": [
        "but without any warranty without even the implied warranty of >merchantability or fitness for a particular purpose see the gnu affero general public license",
        "specifically designed to ensure >cooperation with the community in the case of network server software",
    ],
    "MPL": [
        "software distributed under the license is distributed on an as is basis without >warranty of any kind either express or implied see the license for the specific language governing rights and limitations",
        "covered software is provided under this license on an as is basis without >warranty of any kind either expressed implied or statutory",
    ],
    "EPL": [
        "set forth in this agreement(?: and to the extent permitted by applicable law)? the program is provided on an as is basis without >warranties or conditions of any kind",
    ],
    "OFL-1.1": [
        "the font software is provided as is without >warranty of any kind express or implied",
        "the goals of the open font >license ofl are to stimulate worldwide development of collaborative font projects",
    ],
    "Artistic-1.0": [
        "this package is provided as is and without any express or implied >warranties",
    ],
    "CC": [
        "unless otherwise separately undertaken by the licensor to the extent possible the licensor offers the >licensed material as is and as available",
        "creative >commons corporation is not a law firm and does not provide legal services or legal advice",
        "by exercising the >licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons",
    ],
    "CC0-1.0": [
        "affirmer offers the work as is and makes no representations or >warranties of any kind concerning the work",
    ],
    "PostgreSQL": [
        "specifically disclaims any warranties including but not limited to the implied warranties of >merchantability and fitness for a particular purpose the software provided hereunder is on an as is basis",
    ],
    "MS-PL": [
        "the software is licensed as is you bear the risk of using it the contributors give no express >warranties guarantees or conditions",
    ],
    "public-domain": [
        "(?:this|the) (?:work|file|code|software|document|program) (?:is|has been placed|was placed) in the public >domain",
        "the author disclaims >copyright to this source code in place of a legal notice here is a blessing",
        "may you do good and not evil may you find >forgiveness for yourself and forgive others",
        "work of the (?:united states|u s) government (?:and is )?not subject to >copyright protection",
    ],
}

# Priority and confidence by kind of clause.
KINDS = [(GRANTS, 2, 0.9), (CONDITIONS, 2, 0.85), (DISCLAIMERS, 3, 0.5)]


def clauses() -> list[tuple[str, str, int, float]]:
    """Label, pattern, priority and confidence of every clause in order."""
    return [(label, p, priority, sure) for table, priority, sure in KINDS for label, texts in table.items() for p in texts]


def keyword(pattern: str) -> str:
    """The longest run of plain words that every match of a pattern holds, its anchor left out."""
    runs = [""]
    depth = 0
    for word in pattern.split(" "):
        opened, closed = word.count("("), word.count(")")
        plain = depth == 0 and not opened and word.isalnum()
        depth += opened - closed
        if plain:
            runs[-1] = f"{runs[-1]} {word}".strip()
        elif runs[-1]:
            runs.append("")
    return max(runs, key=len)
